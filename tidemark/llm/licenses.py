"""License scans: ordered signature rules (operator 3).

Rules are hand-written regexes over the words of a text (lower case, joined by single spaces): characteristic sentences of license
texts, names with versions, names, families, and notices, in this order of priority. A
rule runs only where its keyword stands in the text. Detections are resolved in that order: one is taken unless it overlaps one that was
taken before, so of detections inside one another, or that cross, the one of higher priority stays, and of one priority the longer one. A
generic notice stays where nothing better stands in it. Labels of the base phrases always stay.

One narrow stage over Arrow batches; nothing is shuffled. Defined cases: empty and null texts have no words, no labels and score 0; a
text of any length is scanned whole; rows that repeat and null ids pass through, each with its result; columns named as a
result in any case are replaced, others pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import tokens
from tidemark.llm.frames import map_texts

#: Fixed phrases and labels of the base rules.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Priorities of the kinds of rules, by which detections are ordered; at most 100, as the score is theirs. Labels count from LEAST on.
KINDS = {"texts": 80, "versions": 65, "names": 60, "families": 45, "rights": 30, "notices": 5}
LEAST = 20

#: The rules: label, keyword of the prefilter and pattern, one a line.
RULES = {
    "texts": """
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | substantial portions | shall be included in all copies or substantial portions of the software
mit-0 | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3 | endorse or promote | neither the names? of .{1,80}? may be used to endorse or promote products derived from this software
bsd-4 | advertising materials | all advertising materials mentioning features or use of this software must display
bsd-2-patent | patent license | hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable .{0,40}?patent license
bsd-3-clear | patent rights | no express or implied licenses to any party s patent rights are granted by this license
apache-2 | 2 0 the license | licensed under the apache license version 2 0 the license
apache-2 | contributor hereby grants | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
apache-1 | apache group | this product includes software developed by the apache group
gpl | gnu general public | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl-2 | gnu general public | terms of the gnu general public license as published by the free software foundation version 2(?: of the license)?(?! or)
gpl-2-or-later | gnu general public | terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3 | gnu general public | terms of the gnu general public license as published by the free software foundation version 3(?: of the license)?(?! or)
gpl-3-or-later | gnu general public | terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-1-or-later | gnu general public | terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version
gpl-3 | anti circumvention | no covered work shall be deemed part of an effective technological measure
lgpl-2-or-later | gnu library | terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl-2.1-or-later | gnu lesser | terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3-or-later | gnu lesser | terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3-or-later | gnu affero | terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3 | remotely through a computer network | all users interacting with it remotely through a computer network
gfdl | gnu free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-1.1 | mozilla public | contents of this file are subject to the mozilla public license version 1 1
mpl-1 | mozilla public | contents of this file are subject to the mozilla public license version 1 0
mpl-2 | mozilla public | this source code form is subject to the terms of the mozilla public license v 2 0
npl-1.1 | netscape public | contents of this file are subject to the netscape public license version 1 1
epl-1 | eclipse public | made available under the terms of the eclipse public license v ?1 0
epl-2 | eclipse public | made available under the terms of the eclipse public license (?:v |version )?2 0
cddl-1 | common development | subject to the terms of the common development and distribution license
cpl-1 | common public | made available under the terms of the common public license v ?1 0
eupl-1.2 | eupl | licensed under the eupl version 1 2
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | do what the fuck | you just do what the fuck you want to
zlib | express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib | misrepresented | the origin of this software must not be misrepresented
bsl-1 | machine executable | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
cc0-1 | waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0-1 | related or neighboring | to the extent possible under law the (?:author s|person who associated cc0|copyright holders?) .{0,40}?ha(?:s|ve) (?:dedicated|waived) all copyright and related or neighboring rights
cc-by-4 | creativecommons | creativecommons org licenses by 4 0
cc-by-3 | creativecommons | creativecommons org licenses by 3 0
cc-by-2.5 | creativecommons | creativecommons org licenses by 2 5
cc-by-2 | creativecommons | creativecommons org licenses by 2 0
cc-by-sa-4 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-sa-2.5 | creativecommons | creativecommons org licenses by sa 2 5
cc-by-nd-4 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nd-3 | creativecommons | creativecommons org licenses by nd 3 0
cc-by-nc-4 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-3 | creativecommons | creativecommons org licenses by nc 3 0
cc-by-nc-sa-4 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3 | creativecommons | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3 | creativecommons | creativecommons org licenses by nc nd 3 0
cc0-1 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | creativecommons org publicdomain mark 1 0
ofl-1.1 | font software | this font software is licensed under the sil open font license version 1 1
odbl-1 | open database | made available under the open database license
pddl-1 | public domain dedication | made available under the public domain dedication and license
artistic-2 | artistic | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package
artistic-1 | package | the intent of this document is to state the conditions under which a package may be copied
beerware | beer | you can buy me a beer in return
json | good not evil | the software shall be used for good not evil
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric young | this product includes cryptographic software written by eric young
postgresql | university of california | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
curl | permission to use | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
python-2 | psf is making | psf is making python available to licensee on an as is basis
ijg | independent jpeg | this software is based in part on the work of the independent jpeg group
ftl | freetype | portions of this software are copyright .{0,30}?the freetype project
libpng | png reference library | the png reference library is supplied as is
php-3.01 | php software | this product includes php software freely available from
vim | vim | this is a modified version of vim|there are no restrictions on distributing unmodified copies of vim
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
icu | unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
ms-pl | microsoft public | if you use the software you accept this license if you do not accept the license do not use the software
bsl-business | additional use grant | you may make use of the licensed work provided that
sspl-1 | service source code | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons clause | the license does not grant to you the right to sell the software
openrail | use based restrictions | you agree not to use the model or derivatives of the model
llama | llama | llama [0-9]+ is licensed under the llama [0-9]+ community license
""",
    "versions": """
gpl-1-or-later | gpl | gpl (?:version |v ?)?1(?: 0)?(?: or (?:any |at your option any )?later(?: version)?| plus)
gpl-2-or-later | gpl | gpl (?:version |v ?)?2(?: 0)?(?: or (?:any |at your option any )?later(?: version)?| plus)
gpl-3-or-later | gpl | gpl (?:version |v ?)?3(?: 0)?(?: or (?:any |at your option any )?later(?: version)?| plus)
gpl-1 | gpl | (?:gnu )?gpl (?:version |v ?)?1(?: 0)?(?: only)?
gpl-2 | gpl | (?:gnu )?gpl (?:version |v ?)?2(?: 0)?(?: only)?
gpl-3 | gpl | (?:gnu )?gpl (?:version |v ?)?3(?: 0)?(?: only)?
gpl-2 | gplv2 | gplv2(?: only)?
gpl-3 | gplv3 | gplv3(?: only)?
gpl-2-or-later | gplv2 | gplv2 or (?:any )?later
gpl-3-or-later | gplv3 | gplv3 or (?:any )?later
gpl-1-or-later | general public | (?:gnu )?general public license (?:version |v ?)?1(?: 0)? or (?:any |at your option any )?later(?: version)?
gpl-2-or-later | general public | (?:gnu )?general public license (?:version |v ?)?2(?: 0)? or (?:any |at your option any )?later(?: version)?
gpl-3-or-later | general public | (?:gnu )?general public license (?:version |v ?)?3(?: 0)? or (?:any |at your option any )?later(?: version)?
gpl-1 | general public | (?:gnu )?general public license (?:version |v ?)?1(?: 0)?
gpl-2 | general public | (?:gnu )?general public license (?:version |v ?)?2(?: 0)?
gpl-3 | general public | (?:gnu )?general public license (?:version |v ?)?3(?: 0)?
lgpl-2.1-or-later | lgpl | (?:gnu )?lgpl (?:version |v ?)?2 1(?: or (?:any )?later(?: version)?| plus)
lgpl-3-or-later | lgpl | (?:gnu )?lgpl (?:version |v ?)?3(?: 0)?(?: or (?:any )?later(?: version)?| plus)
lgpl-2 | lgpl | (?:gnu )?lgpl (?:version |v ?)?2(?: 0)?(?: only)?
lgpl-2.1 | lgpl | (?:gnu )?lgpl (?:version |v ?)?2 1(?: only)?
lgpl-3 | lgpl | (?:gnu )?lgpl (?:version |v ?)?3(?: 0)?(?: only)?
lgpl-2.1-or-later | lesser general | (?:gnu )?lesser general public license (?:version |v ?)?2 1 or (?:any )?later(?: version)?
lgpl-3-or-later | lesser general | (?:gnu )?lesser general public license (?:version |v ?)?3(?: 0)? or (?:any )?later(?: version)?
lgpl-2 | library general | (?:gnu )?library general public license (?:version |v ?)?2(?: 0)?
lgpl-2.1 | lesser general | (?:gnu )?lesser general public license (?:version |v ?)?2 1
lgpl-3 | lesser general | (?:gnu )?lesser general public license (?:version |v ?)?3(?: 0)?
agpl-1 | agpl | (?:gnu )?agpl (?:version |v ?)?1(?: 0)?
agpl-3-or-later | agpl | (?:gnu )?agpl (?:version |v ?)?3(?: 0)?(?: or (?:any )?later(?: version)?| plus)
agpl-3 | agpl | (?:gnu )?agpl (?:version |v ?)?3(?: 0)?(?: only)?
agpl-3-or-later | affero | (?:gnu )?affero general public license (?:version |v ?)?3(?: 0)? or (?:any )?later(?: version)?
agpl-3 | affero | (?:gnu )?affero general public license (?:version |v ?)?3(?: 0)?
gfdl-1.1 | free documentation | (?:gnu )?free documentation license (?:version |v ?)?1 1
gfdl-1.2 | free documentation | (?:gnu )?free documentation license (?:version |v ?)?1 2
gfdl-1.3 | free documentation | (?:gnu )?free documentation license (?:version |v ?)?1 3
gfdl-1.2 | gfdl | gfdl (?:version |v ?)?1 2
gfdl-1.3 | gfdl | gfdl (?:version |v ?)?1 3
apache-1 | apache | apache (?:software )?(?:licen[sc]e )?(?:version |v ?)?1 0
apache-1.1 | apache | apache (?:software )?(?:licen[sc]e )?(?:version |v ?)?1 1
apache-2 | apache | apache (?:software )?(?:licen[sc]e )?(?:version |v ?)?2(?: 0)?
apache-2 | apachev2 | apachev2
mpl-1 | mozilla | mozilla public licen[sc]e (?:version |v ?)?1 0
mpl-1.1 | mozilla | mozilla public licen[sc]e (?:version |v ?)?1 1
mpl-2 | mozilla | mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?
mpl-1.1 | mpl | mpl (?:version |v ?)?1 1
mpl-2 | mpl | mpl (?:version |v ?)?2(?: 0)?
epl-1 | eclipse | eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?
epl-2 | eclipse | eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?
epl-1 | epl | epl (?:version |v ?)?1 0
epl-2 | epl | epl (?:version |v ?)?2 0
edl-1 | eclipse | eclipse distribution licen[sc]e (?:version |v ?)?1 0
cpl-1 | common public | common public licen[sc]e (?:version |v ?)?1 0
cddl-1 | cddl | cddl (?:version |v ?)?1 0
cddl-1.1 | cddl | cddl (?:version |v ?)?1 1
cddl-1 | common development | common development and distribution licen[sc]e (?:version |v ?)?1 0
cddl-1.1 | common development | common development and distribution licen[sc]e (?:version |v ?)?1 1
eupl-1.1 | eupl | eupl (?:version |v ?)?1 1
eupl-1.2 | eupl | eupl (?:version |v ?)?1 2
eupl-1.2 | european union | european union public licen[sc]e (?:version |v ?)?1 2
osl-3 | open software | open software licen[sc]e (?:version |v ?)?3 0
osl-2.1 | open software | open software licen[sc]e (?:version |v ?)?2 1
afl-3 | academic free | academic free licen[sc]e (?:version |v ?)?3 0
afl-2.1 | academic free | academic free licen[sc]e (?:version |v ?)?2 1
artistic-1 | artistic | artistic licen[sc]e (?:version |v ?)?1 0
artistic-2 | artistic | artistic licen[sc]e (?:version |v ?)?2(?: 0)?
bsl-1 | boost | boost software licen[sc]e (?:version |v ?)?1 0
odbl-1 | open database | (?:odc )?open database licen[sc]e (?:version |v ?)?1 0
odc-by-1 | open data commons | open data commons attribution licen[sc]e (?:version |v ?)?1 0
ofl-1.1 | open font | (?:sil )?open font licen[sc]e (?:version |v ?)?1 1
cecill-2.1 | cecill | cecill (?:version |v ?)?2 1
php-3.01 | php | php licen[sc]e (?:version |v ?)?3 01
python-2 | python | (?:python software foundation|psf) licen[sc]e (?:version |v ?)?2
zpl-2.1 | zope | zope public licen[sc]e (?:version |v ?)?2 1
lppl-1.3c | latex project | latex project public licen[sc]e (?:version |v ?)?1 3c?
upl-1 | universal permissive | universal permissive licen[sc]e (?:version |v ?)?1 0
mulan-2 | mulan | mulan (?:permissive software licen[sc]e|psl) (?:version |v ?)?2
sspl-1 | server side public | server side public licen[sc]e (?:version |v ?)?1
elastic-2 | elastic | elastic licen[sc]e (?:version |v ?)?2(?: 0)?
bsl-business-1.1 | business source | business source licen[sc]e (?:version |v ?)?1 1
cc0-1 | cc0 | cc0 1 0(?: universal)?
cc-by-4 | cc by | cc by 4 0
cc-by-3 | cc by | cc by 3 0
cc-by-2.5 | cc by | cc by 2 5
cc-by-2 | cc by | cc by 2 0
cc-by-sa-4 | cc by sa | cc by sa 4 0
cc-by-sa-3 | cc by sa | cc by sa 3 0
cc-by-sa-2.5 | cc by sa | cc by sa 2 5
cc-by-sa-2 | cc by sa | cc by sa 2 0
cc-by-nd-4 | cc by nd | cc by nd 4 0
cc-by-nd-3 | cc by nd | cc by nd 3 0
cc-by-nc-4 | cc by nc | cc by nc 4 0
cc-by-nc-3 | cc by nc | cc by nc 3 0
cc-by-nc-2 | cc by nc | cc by nc 2 0
cc-by-nc-sa-4 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-sa-3 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-nd-4 | cc by nc nd | cc by nc nd 4 0
cc-by-nc-nd-3 | cc by nc nd | cc by nc nd 3 0
cc-by-4 | creative commons | creative commons attribution 4 0(?: international)?(?: licen[sc]e)?
cc-by-3 | creative commons | creative commons attribution 3 0(?: unported)?(?: licen[sc]e)?
cc-by-sa-4 | creative commons | creative commons attribution share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-sa-3 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-nd-4 | creative commons | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-4 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-3 | creative commons | creative commons attribution non ?commercial 3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-sa-4 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-sa-3 | creative commons | creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-nd-4 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[sc]e)?
""",
    "names": """
mit | mit | (?:licensed under )?(?:the )?mit licen[sc]e
mit | mit | (?:licensed|released|available) under (?:the )?mit
mit | expat | expat licen[sc]e
x11 | x11 | x11 licen[sc]e
isc | isc | isc licen[sc]e
0bsd | 0bsd | 0bsd
0bsd | zero clause | (?:bsd zero clause|zero clause bsd)(?: licen[sc]e)?
bsd-2 | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-3 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-4 | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[sc]e)?
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
zlib | zlib | zlib(?: libpng)? licen[sc]e
cc0 | cc0 | cc0
cc0 | creative commons zero | creative commons zero
cc-by | cc by | cc by
cc-by-sa | cc by sa | cc by sa
cc-by-nd | cc by nd | cc by nd
cc-by-nc | cc by nc | cc by nc
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc-by | creative commons | creative commons attribution(?: licen[sc]e)?
cc-by-sa | creative commons | creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)?
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: licen[sc]e)?
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[sc]e)?
ofl | open font | (?:sil )?open font licen[sc]e
pddl | dedication and licen | public domain dedication and licen[sc]e
odbl | open database | (?:odc )?open database licen[sc]e
bsl-1 | boost | boost software licen[sc]e
beerware | beerware | beerware(?: licen[sc]e)?
postgresql | postgresql | postgresql licen[sc]e
python-2 | python software foundation | python software foundation licen[sc]e
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
w3c | w3c | w3c software (?:notice and )?licen[sc]e
ms-pl | microsoft public | microsoft public licen[sc]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e
openssl | openssl | openssl licen[sc]e
vim | vim licen | vim licen[sc]e
ftl | freetype licen | freetype licen[sc]e
lppl | latex project | latex project public licen[sc]e
sspl-1 | server side public | server side public licen[sc]e
bsl-business | business source | business source licen[sc]e
commons-clause | commons clause | commons clause
openrail | openrail | (?:bigscience |creativeml )?openrail(?: m)?
hpnd | historical permission | historical permission notice and disclaimer
upl-1 | universal permissive | universal permissive licen[sc]e
""",
    "families": """
gpl | gpl | (?:gnu )?gpl(?: licen[sc]e)?
gpl | general public | (?:gnu )?general public licen[sc]e
lgpl | lgpl | (?:gnu )?lgpl(?: licen[sc]e)?
lgpl | lesser general | (?:gnu )?lesser general public licen[sc]e
lgpl | library general | (?:gnu )?library general public licen[sc]e
agpl | agpl | (?:gnu )?agpl(?: licen[sc]e)?
agpl | affero | (?:gnu )?affero general public licen[sc]e
gfdl | gfdl | gfdl
gfdl | free documentation | (?:gnu )?free documentation licen[sc]e
apache | apache | apache (?:software )?licen[sc]e
mpl | mozilla public | mozilla public licen[sc]e
epl | eclipse public | eclipse public licen[sc]e
cddl | common development | common development and distribution licen[sc]e
eupl | european union public | european union public licen[sc]e
osl | open software | open software licen[sc]e
afl | academic free | academic free licen[sc]e
artistic | artistic | artistic licen[sc]e
cecill | cecill | cecill(?: b| c)? licen[sc]e
elastic | elastic licen | elastic licen[sc]e
llama | community licen | llama (?:[0-9]+ )?community licen[sc]e(?: agreement)?
creative-commons | creative commons | creative commons licen[sc]e
bsd | bsd | bsd(?: style)? licen[sc]e
public-domain | public domain | (?:released|dedicated|placed|is) (?:in|into|to) the public domain
""",
    "rights": """
all-rights-reserved | all rights | all rights reserved
proprietary | proprietary | proprietary and confidential
proprietary | may not be | may not be (?:reproduced|redistributed|copied)(?: [a-z]+){0,6} without (?:prior |express )*(?:written )?permission
proprietary | end user licen | end user licen[sc]e agreement
proprietary | trade secret | contains? (?:confidential )?(?:information and )?trade secrets? of
no-commercial-use | commercial use | (?:not for|no) commercial use
""",
    "notices": """
copyright-notice | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
license-notice | licensed under | licensed under (?:the )?(?:terms of )?[a-z0-9]+
license-notice | released under | released under (?:the )?(?:terms of )?[a-z0-9]+
license-notice | distributed under | distributed under (?:the )?(?:terms of )?[a-z0-9]+
license-notice | available under | available under (?:the )?(?:terms of )?[a-z0-9]+
license-notice | licen | see (?:the )?(?:file )?licen[sc]e(?: txt| md)? for (?:more )?(?:details|information|terms)
license-notice | spdx | spdx licen[sc]e identifier [a-z0-9]+
""",
}


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) of all rules, best first."""
    return [(KINDS[kind], *line.split(" | ", 2)) for kind, table in RULES.items() for line in table.strip().split("\n")]


def compiled() -> dict[str, list[tuple[int, str, re.Pattern]]]:
    """(priority, label, pattern) of the rules by keyword."""
    out: dict[str, list] = {}
    for priority, label, key, pattern in rules():
        out.setdefault(key, []).append((priority, label, re.compile(f"(?<= )(?:{pattern})(?= )")))
    return out


def resolved(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Of (begin, end, priority, label), in the order of priority, length, place and label, those that overlap none taken before; by place."""
    begins: list[int] = []
    taken: list[tuple[int, int, int, str]] = []
    for x in sorted(set(found), key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
        at = bisect_left(begins, x[1])  # those before it begin before x ends; the last of them ends last
        if at and taken[at - 1][1] > x[0]:
            continue
        begins.insert(at, x[0])
        taken.insert(at, x)
    return taken


ADDED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(n, T.StringType()) for n in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType())]
    + [T.StructField("detections", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])))]
)


def spaced(data: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, each with one space before, and a space after the last one of a text.

    Returns those bytes, their bounds by text, the words' starts in them, and the words' firsts and sizes.
    """
    starts, ends, firsts = tokens.words(data, bounds, tokens.ALNUM)
    sizes = ends - starts
    owner = tokens.owners(firsts)
    to = np.cumsum(sizes + 1) - sizes + owner  # owner: one closing space for each text before
    out = np.full(int(sizes.sum()) + len(sizes) + len(bounds) - 1, 32, np.uint8)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + at] = data[np.repeat(starts, sizes) + at]
    ends_at = np.cumsum(np.concatenate([[0], tokens.per_text(sizes + 1, firsts) + 1]))
    return out.tobytes(), ends_at, to, firsts, sizes


def scan(texts: pa.Array, by_key: dict[str, list]) -> list[pa.Array]:
    data, bounds = tokens.raw(texts)
    whole, limits, word_at, firsts, _ = spaced(tokens.LOWER[data], bounds)
    rows: list[tuple] = []
    base_bytes = [(f" {p} ".encode(), label) for p, label in BASE.items()]
    for i in range(len(texts)):
        raw = whole[limits[i] : limits[i + 1]]
        own = word_at[firsts[i] : firsts[i + 1]] - limits[i]
        places, base = [], set()
        for phrase, label in base_bytes:
            at = raw.find(phrase)
            while at >= 0:
                places.append(int(np.searchsorted(own, at + 1)))
                base.add(label)
                at = raw.find(phrase, at + 1)
        found = []
        text = None
        for key, own_rules in by_key.items():
            if key.encode() in raw:
                text = text if text is not None else raw.decode("latin-1")  # bytes as characters: the same positions
                for priority, label, pattern in own_rules:
                    found += [(*m.span(), priority, label) for m in pattern.finditer(text)]
        spans = resolved(found)
        best = max((p for *_, p, _ in spans), default=0)
        labels = base | {label for *_, p, label in spans if p >= LEAST}
        score = 1.0 if base else best / 100
        detections = [{"label": label, "first_word": int(np.searchsorted(own, b)), "end_word": int(np.searchsorted(own, e))} for b, e, _, label in spans]
        rows.append((len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, detections))
    columns = list(zip(*rows, strict=True)) or [()] * len(ADDED)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))]
    return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of docs with the columns of ADDED; detections are the resolved spans in words."""

    def make():
        by_key = compiled()
        return lambda texts: scan(texts, by_key)

    return map_texts(docs, text_col, ADDED, make)
