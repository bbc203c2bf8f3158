"""HTML extraction: text-to-tag ratios over parser events (operator 4).

The standard library's parser streams events; blocks of text are the lines. A line's ratio is its text
over its tags; the ratios are smoothed by a Gaussian, and lines above a threshold (the smoothed ratios'
deviation) form the content cluster. The cluster decides three things:

- the content region: the article or main element with most of its text, and the articles beside it; on pages without such elements the
  innermost container that holds nearly all of it;
- parts whose class or id has a word that articles use too (related, share, notice, header and the like), or a telling word beside others
  (newsletter-issue, ad-history): they stay where they are content, that is long, in the cluster and not made of links, and go otherwise. So do
  an article's own footer, and forms and fieldsets with controls; those without any stay;
- wrappers: a part that holds an article and half the page's text, or half the page's text as content, is no menu or sidebar, whatever its class says.

Reader comments are containers named as such (comments, comment-list); a paragraph of class reply is none, nor is an article of a
site whose class says comments-open. Several articles are all kept, side by side or in containers of their own where they are of like size.

Of the region every block is kept, short ones too, but for what is no article text: menus, page headers, footers, sidebars, notices, adverts,
forms, dialogs, scripts, styles, reader comments, hidden parts (by style too) and the fallback of embedded media. An article's own header,
formulas, drawings' texts and labels outside forms are article text. What goes inside a line doesn't cut the line in two.

One narrow stage over Arrow batches; time and memory are linear in a page's length. Defined cases: null, empty and text-free pages give
an empty text; a page of any length is read whole; an unclosed comment is what the parser makes of it; repeated rows give repeated
results; a column named main_text in any case is replaced, others pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.frames import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without article text: blocks; parts of a line that are seen, which part the words beside them; and those that are not seen.
NO_BLOCKS = frozenset("head title nav header footer aside dialog menu menuitem".split())
#: What one fills in or presses; forms are told by it.
CONTROLS = frozenset("input select textarea button".split())
NO_WIDGETS = frozenset("button select textarea iframe object canvas audio video".split())
NO_CODE = frozenset("script style noscript template".split())
#: Words of class and id names of reader comments, of other parts that are none of the article, and of parts that may be.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
MARKS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead menu nav navbar navigation newsletter "
    "pagination pager popup promo promoted sidebar sidebars signup sponsor sponsored subscribe subscription".split()
)
MAYBE = frozenset("banner copyright disclaimer header modal notice notices notification promotion recommended related share sharing skip social toc toolbar topbar widget widgets".split())
#: Words beside these that say nothing of what a part is: with them alone a name is as telling as its one word.
PLACES = frozenset("area bar block body bottom box center col column container content footer form head header holder inline inner item left line link links list main outer panel right row section slot space text thread title top unit wrap wrapper zone".split())
#: Elements that can hold a reader's comment.
HOLDERS = frozenset("article aside div dl footer li ol section ul".split())
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Words of names after which they tell of a part elsewhere, as in no-sidebar.
ELSEWHERE = frozenset("has hide no with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: A start tag of these ends an open element of the named kinds within the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("html body article main section div td ul ol table blockquote figure form aside nav header footer".split())
NAME_WORDS = re.compile(r"[a-z]+")
#: Radius of the Gaussian in lines and share of the cluster's text that the region must hold.
RADIUS, SHARE = 2, 0.9
#: What a part with a doubtful name must have to be content: characters (fewer where only one word of the name tells), share in the cluster,
#: and most share in links; and characters for each control that a form must have.
PART_CHARS, WEAK_CHARS, PART_SHARE, PART_LINKS, CONTROL_CHARS = 200, 100, 0.5, 0.3, 50
#: Share of the largest article's text that makes one in another container part of the page's text, beside PART_CHARS.
ARTICLE_SHARE = 0.25


#: The state outside all elements; see Page.stack.
NOTHING = ("", "", -1, 0, False, False)


class Page(HTMLParser):
    """A page as lines (text, tags, container, no article text, part, characters in links) with its containers and doubtful parts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # tag, what it hides ("", "block" or "inline"), part, container, in a link, in an article
        self.stack: list[tuple[str, str, int, int, bool, bool]] = []
        self.open: Counter = Counter()  # of the tags on the stack, so that most tags needn't be looked for
        self.containers: list[tuple[int, str, int]] = [(-1, "", -1)]  # parent, tag, part
        self.parts: list[tuple[int, str]] = []  # parent, kind
        self.controls: list[int] = []  # of each part
        self.lines: list[tuple[str, int, int, bool, int, int]] = []
        self.words: list[str] = []
        self.tags = self.linked = 0

    def top(self) -> tuple[str, str, int, int, bool, bool]:
        return self.stack[-1] if self.stack else NOTHING

    def close_from(self, at: int) -> None:
        self.end_line()
        self.open.subtract(x[0] for x in self.stack[at:])
        del self.stack[at:]

    def end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            # What hides inside a line has added no words to it; what the line stands in counts.
            _, hides, part, container, *_ = next((x for x in reversed(self.stack) if x[1] != "inline"), NOTHING)
            self.lines.append((text, self.tags, container, hides == "block", part, min(self.linked, len(text))))
            self.tags = 0
        self.words.clear()
        self.linked = 0

    def kind(self, tag: str, attrs: list) -> str:
        """What the element's names say: "" for nothing, "comments", "none", "weak" (one word among others) or "maybe"; of an article's own header nothing."""
        if tag in ("html", "body"):
            return ""
        in_article = self.top()[5]
        said = {"form"} if tag in ("form", "fieldset") else {"maybe"} if tag == "footer" and in_article else set()
        for key, value in attrs:
            if key not in ("class", "id") or not value:
                continue
            for name in value.lower().split():
                words = list(takewhile(lambda w: w not in ELSEWHERE, NAME_WORDS.findall(name)))
                alone = all(w in MARKS or w in MAYBE or w in PLACES for w in words)
                if not COMMENTS.isdisjoint(words):
                    if tag in HOLDERS:
                        said.add("comments" if alone else "weak")
                elif not MARKS.isdisjoint(words):
                    said.add("none" if alone else "weak")
                elif not MAYBE.isdisjoint(words) and not (in_article and "header" in words):
                    said.add("maybe")
        if tag in ("article", "main"):
            said &= {"comments"}
        return next((k for k in ("comments", "none", "form", "maybe", "weak") if k in said), "")

    def hides(self, tag: str, attrs: list) -> str:
        if tag in NO_CODE or tag in NO_WIDGETS:
            return "inline"
        if tag in NO_BLOCKS and not (tag in ("header", "footer") and self.top()[5]):
            return "block"
        if tag == "label" and self.open["form"] > 0:
            return "inline"
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value and value.lower() in ROLES or key == "style" and value and HIDDEN_STYLE.search(value):
                return "block" if tag in BLOCK else "inline"
        return ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br" or tag in NO_WIDGETS or tag == "input":
            self.words.append(" ")
        if tag in CONTROLS and self.top()[2] >= 0 and ("type", "hidden") not in attrs:
            self.controls[self.top()[2]] += 1
        if (tag in BLOCK or tag in NO_BLOCKS) and self.top()[1] != "inline":
            self.end_line()
            ended = ENDS.get(tag, set()) | ({"p"} if tag in BLOCK else set())
            if any(self.open[t] > 0 for t in ended):
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] in ended:
                        self.close_from(i)
                        break
                    if self.stack[i][0] in CONTAINERS:
                        break
        if tag in VOID:
            return
        _, hides, part, container, link, in_article = self.top()
        kind = self.kind(tag, attrs)
        if kind:
            self.parts.append((part, kind))
            self.controls.append(0)
            part = len(self.parts) - 1
        if tag in CONTAINERS:
            self.containers.append((container, tag, part))
            container = len(self.containers) - 1
        self.stack.append((tag, hides or self.hides(tag, attrs), part, container, link or tag == "a", in_article or tag in ("article", "main")))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        blocks = tag in BLOCK or tag in NO_BLOCKS
        if blocks:
            self.end_line()
        if self.open[tag] <= 0:
            return  # a stray end tag
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if blocks:
                    self.close_from(i)
                else:
                    self.open[tag] -= 1
                    del self.stack[i]
                return
            if self.stack[i][0] in CONTAINERS and tag not in CONTAINERS:
                return  # one of an element outside

    def handle_data(self, data: str) -> None:
        _, hides, _, _, link, _ = self.top()
        if hides != "inline":
            self.words.append(data)
            self.linked += len(data) if link else 0


def smoothed(raw: np.ndarray) -> np.ndarray:
    x = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(x**2) / (2 * (RADIUS / 2) ** 2))
    return np.convolve(np.pad(raw, RADIUS), kernel / kernel.sum(), "valid")


def tally(page: Page) -> tuple[list[int], list[int], list[int], list[int], int]:
    """Of each part with a telling name its characters, those in links, its articles and controls, with the parts inside; and the characters of the page."""
    chars, linked, articles = ([0] * len(page.parts) for _ in range(3))
    controls, total = list(page.controls), 0
    for text, _, _, hidden, part, link in page.lines:
        if not hidden:
            total += len(text)
            if part >= 0:
                chars[part] += len(text)
                linked[part] += link
    for _, tag, part in page.containers:
        if part >= 0 and tag in ("article", "main"):
            articles[part] += 1
    for k in range(len(page.parts) - 1, -1, -1):  # a part comes after the one around it
        if (parent := page.parts[k][0]) >= 0:
            for counts in (chars, linked, articles, controls):
                counts[parent] += counts[k]
    return chars, linked, articles, controls, total


def main_text(html: str) -> str:
    """The article's blocks, one a line."""
    page = Page()
    page.feed(html)
    page.close()
    page.end_line()
    lines, parts = page.lines, page.parts
    if not lines:
        return ""
    chars, linked, articles, controls, total = tally(page)
    half = [2 * c >= total for c in chars]
    nothing = [kind == "comments" or kind == "none" and not half[k] for k, (_, kind) in enumerate(parts)]
    raw = np.array([0.0 if hidden or part >= 0 and nothing[part] else len(text) / max(1, tags) for text, tags, _, hidden, part, _ in lines])
    smooth = smoothed(raw)
    above = smooth >= min(float(smooth.std()), float(smooth.max()))
    within = [0] * len(parts)
    for (text, _, _, hidden, part, _), is_content in zip(lines, above.tolist(), strict=True):
        if part >= 0 and is_content and not hidden:
            within[part] += len(text)
    for k in range(len(parts) - 1, -1, -1):
        if parts[k][0] >= 0:
            within[parts[k][0]] += within[k]
    gone: list[bool] = []
    for k, (parent, kind) in enumerate(parts):
        least = max(PART_CHARS, CONTROL_CHARS * controls[k]) if kind == "form" else WEAK_CHARS if kind == "weak" else PART_CHARS
        is_content = chars[k] >= least and within[k] >= PART_SHARE * chars[k] and linked[k] <= PART_LINKS * chars[k]
        wraps = half[k] and (articles[k] > 0 or is_content)
        stays = kind != "comments" and (wraps or kind != "none" and is_content or kind == "form" and not controls[k])
        gone.append(not stays or parent >= 0 and gone[parent])
    stays = [not hidden and (part < 0 or not gone[part]) for _, _, _, hidden, part, _ in lines]
    content = [i for i, ok in enumerate(stays) if ok and above[i]] or [i for i, ok in enumerate(stays) if ok]
    mass = [0] * len(page.containers)
    for i in content:
        mass[lines[i][2] if lines[i][2] >= 0 else 0] += len(lines[i][0])
    for k in range(len(mass) - 1, 0, -1):
        if page.containers[k][0] >= 0:
            mass[page.containers[k][0]] += mass[k]
    named = [k for k, (_, tag, _) in enumerate(page.containers) if tag in ("article", "main") and mass[k]]
    if named:
        best = max(named, key=lambda k: (mass[k], k))
        least = max(PART_CHARS, ARTICLE_SHARE * mass[best])
        inside = {k for k in named if page.containers[k][:2] == page.containers[best][:2] or mass[k] >= least}
    else:
        inside = {max((k for k in range(len(mass)) if mass[k] >= SHARE * mass[0]), default=0)}
    for k in range(min(inside) + 1, len(page.containers)):
        if page.containers[k][0] in inside:
            inside.add(k)
    return "\n".join(line[0] for line, ok in zip(lines, stays, strict=True) if ok and line[2] in inside)


ADDED = T.StructType([T.StructField("main_text", T.StringType())])


def extract(htmls: pa.Array) -> list[pa.Array]:
    return [pa.array([main_text(h.as_py()) if h.as_py() else "" for h in htmls], pa.string())]


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every row of pages with main_text."""
    return map_texts(pages, html_col, ADDED, lambda: extract)
