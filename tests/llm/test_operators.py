import math
import random
import re

import pytest
from pyspark.sql import functions as F

import brute as B
from conftest import DOCS, prose
from tidemark.llm import chat, decontamination, html_extraction, licenses, mixing, pitman_yor, quality, repetition, sketch_join, suffix_dedup
from tidemark.llm.graphs import components, joined

MESSAGES = "tree_id long, message_id long, parent_id long, role string, text string, score double"


def clashing(docs):
    """docs with columns that have the names of results, in other cases too."""
    return docs.select("doc_id", "text", *(F.lit("x").alias(c) for c in ("N_WORDS", "kept", "hit_words", "_text_id", "n_bytes", "Log_Weight", "labels", "main_text", "extra")))


# 1
def paths(spark, rows, branches=1):
    df = spark.createDataFrame(rows, MESSAGES)
    return chat.read_chats(chat.format_chats(df, score_col="score", branches=branches)).orderBy("tree_id", "branch").collect()


def test_chats_choose_the_best_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 2, "user", "more", 5.0), (1, 5, 3, "user", "less", 1.0), (2, 1, 9, None, None, None)]
    found = paths(spark, rows, 2)
    assert [[t["text"] for t in r["turns"]] for r in found] == [["q", "a", "more"], ["q", "b", "less"], [""]]
    assert [r["loss_texts"] for r in found] == [["a"], ["b"], []] and found[2]["turns"][0]["role"] == ""


def test_chats_are_read_back_whatever_the_texts_hold(spark):
    rng = random.Random(3)
    bits = ["\\", "\\b", "\\h", "\\e", "###", "### ", "####", "</turn>", "</turn", "\n", ":\n", "assistant", "ü", "😀", "", "\n</turn>\n", "\\\\"]
    said = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 9))), rng.choice(["user", "assistant", "a:\nb", "\\c", "###"])) for _ in range(60)]
    rows = [(7, i, i - 1 if i else None, role, text, 0.0) for i, (text, role) in enumerate(said)]
    (r,) = paths(spark, rows)
    assert [(t["text"], t["role"]) for t in r["turns"]] == said and r["loss_texts"] == [t for t, role in said if role == "assistant"]
    for s in r["loss_spans"]:
        assert chat.HEAD not in r["formatted"][s["start"] : s["start"] + s["length"]]


def test_chats_bear_cycles_repeats_and_nulls(spark):
    rows = [(1, 1, 2, "u", "x", 0.0), (1, 2, 1, "u", "y", 0.0), (1, 3, 2, "u", "into the cycle", 0.0), (None, 1, None, "u", "n", 0.0), (None, 1, None, "u", "n", 0.0), (4, None, None, "u", "no id", 0.0), (5, 1, 1, "u", "own parent", 0.0)]
    found = paths(spark, rows)
    assert [(r["tree_id"], [t["text"] for t in r["turns"]]) for r in found] == [(None, ["n"])]
    assert paths(spark, rows[:0]) == [] if rows[:0] else spark.createDataFrame([], MESSAGES).transform(chat.format_chats).count() == 0


def test_a_long_tree(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", str(i), 1.0) for i in range(300)] + [(2, i, 0 if i else None, "user", str(i), float(i)) for i in range(50)]
    found = paths(spark, rows)
    assert [t["text"] for t in found[0]["turns"]] == [str(i) for i in range(300)] and [t["text"] for t in found[1]["turns"]] == ["0", "49"]


# 2
def test_components_of_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300, x) for x in range(301, 340)] + [(x, x + 1) for x in range(400, 460)]
    want = B.components(sorted({x for p in links for x in p}), links)
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["id"]: r["component"] for r in components(df.where("a <> b")).collect()} == {k: v for k, v in want.items() if k in {x for a, b in links if a != b for x in (a, b)}}
    first, second = df.where("a % 2 = 0 and a <> b"), df.where("a % 2 = 1 and a <> b")
    both = {r["id"]: r["component"] for r in joined(components(first), second).collect()}
    assert both == {k: v for k, v in want.items() if k in both} and len(both) == len({x for a, b in links if a != b for x in (a, b)})


@pytest.mark.parametrize("stars", [1, 3])
def test_jaccard_components(spark, texts, stars):
    rows = list(enumerate(texts))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sketch_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(4), stars=stars).collect()}
    assert found == B.jaccard(rows)


def test_jaccard_of_drifting_copies_and_quoted_passages(spark):
    rng = random.Random(11)
    rows, passage = [], prose(rng, 60)
    for g in range(4):
        w = prose(rng, 40 + 90 * g).split()
        for _ in range(25):
            w = list(w)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, f"{passage} {prose(rng, rng.randint(2, 40))}") for i in range(40)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sketch_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert found == B.jaccard(rows)


def test_jaccard_of_short_texts(spark):
    """Of 8 and 9 words, one text being the other and a word: 4 and 5 shingles, which now and then share no cell."""
    rows = []
    for i in range(3000):
        words = [f"w{i}x{j}" for j in range(9 + i % 2)]
        rows += [(2 * i, " ".join(words[:-1])), (2 * i + 1, " ".join(words))]
    found = {r["doc_id"]: r["component_id"] for r in sketch_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert found == {i: i - i % 2 for i in range(6000)}


def test_jaccard_ends_with_the_round_that_links_nothing(spark, monkeypatch):
    """Every query of a round is a load for the driver: none runs on open cells that the round before left as they were, none without open cells."""
    rng = random.Random(12)
    pairs = [w for _ in range(40) for w in [prose(rng, 90)] for w in (w, f"{w} {prose(rng, 2)}")]
    same = prose(rng, 60)
    tables, frames_written = [], sketch_join.written
    monkeypatch.setattr(sketch_join, "written", lambda table, what: tables.append(what) or frames_written(table, what))
    for texts, most in ((pairs, ("join-open", 1)), (pairs + [f"{same} {prose(rng, 40)}" for _ in range(40)], ("join-open", 1)), (pairs, ("join-pairs", 0))):
        tables.clear()
        rows = list(enumerate(texts))
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sketch_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
        assert found == B.jaccard(rows)
        assert tables.count(most[0]) <= most[1], tables


def test_one_of_each_group_stays(spark, docs, texts):
    kept = sketch_join.one_of_each(clashing(docs))
    assert kept.columns == clashing(docs).columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = B.jaccard(list(enumerate(texts)))
    assert sorted(i for i in ids if i is not None) == sorted({c if n else i for i, (n, c) in want.items()}) and None not in ids
    assert sketch_join.jaccard_components(docs.limit(0)).count() == 0 and sketch_join.one_of_each(docs.limit(0)).count() == 0


# 3, 8, 10
LICENSED = [None, "", "Under the MIT License, and under-the-mit.license", "Apache License, Version 2.0 or CC BY NC 4.0", "cc by nc cc by nc-sa 4.0 under the mit license", "cc by", "GNU General Public License version 3 or any later version", "nothing here", "İ under the mit license ünder", "All rights reserved. Copyright (c) 2020"]


def test_licenses(spark, docs, texts):
    df = spark.createDataFrame(list(enumerate(LICENSED)), DOCS).unionByName(docs)
    rows = licenses.scan_licenses(clashing(df)).collect()
    want = B.by_key((i, B.licenses(t)) for i, t in [*enumerate(LICENSED), *enumerate(texts), (None, texts[9]), (9, texts[9]), (9, texts[9])])
    assert B.by_key((r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in rows) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(LICENSED)), DOCS)).collect()}
    assert found[6]["labels"] == "gpl-3-or-later" and found[7]["labels"] == "" and found[7]["score"] == 0 and "cc-by-nc-sa-4" in found[4]["labels"] and len(licenses.rules()) > 200
    for r in licenses.scan_licenses(df.select("doc_id", "text")).collect():
        labels, best = B.license_labels(r["text"], licenses.rules(), licenses.LEAST)
        base = set(filter(None, r["base_labels"].split(",")))
        assert r["labels"] == ",".join(sorted(labels | base)) and r["score"] == (1.0 if base else best / 100)


def test_the_better_of_overlapping_detections_stays():
    assert licenses.resolved([(0, 10, 5, "a"), (2, 6, 9, "b"), (8, 14, 1, "c"), (0, 10, 6, "d"), (9, 12, 9, "e")]) == [(2, 6, 9, "b"), (9, 12, 9, "e")]
    assert licenses.resolved([(0, 30, 5, "license-notice"), (10, 22, 80, "mit")]) == [(10, 22, 80, "mit")]
    rng = random.Random(12)
    for _ in range(200):
        found = {(a := rng.randrange(60), a + rng.randint(1, 20), rng.choice([5, 60, 80]), rng.choice("xyz")) for _ in range(rng.randint(0, 30))}
        left, taken = set(found), []
        while left:
            best = min(left, key=lambda x: (-x[2], -(x[1] - x[0]), x[0], x[3]))
            taken.append(best)
            left = {x for x in left if x[1] <= best[0] or x[0] >= best[1]}
        assert licenses.resolved(list(found)) == sorted(taken)


def test_license_rules_on_generated_texts(spark):
    """Texts of pieces of the rules' own words, so that detections nest and cross."""
    rng = random.Random(14)
    bits = ["gnu", "gpl", "general public license", "version 2", "v3", "or any later version", "lesser", "apache", "license", "2.0", "under the", "mit", "licensed under", "cc by", "nc", "sa", "4.0", "bsd", "3-clause", "all rights reserved", "copyright 2020", "creative commons", "attribution", "the unlicense", "word"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))) for i in range(300)]
    for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect():
        labels, _ = B.license_labels(r["text"], licenses.rules(), licenses.LEAST)
        assert r["labels"] == ",".join(sorted(labels | set(filter(None, r["base_labels"].split(","))))), r["text"]


def test_repetition_rules(docs, texts):
    rows = repetition.repetition_rules(clashing(docs)).collect()
    want = B.by_key((i, B.rules(t)) for i, t in [*enumerate(texts), (None, texts[9]), (9, texts[9]), (9, texts[9])])
    assert B.by_key((r["doc_id"], tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows) and any(r["kept"] for r in rows)


def test_repetition_verdicts(spark):
    """kept by brute force; every n-gram length rejects some text that no other rule does."""
    rng = random.Random(15)
    rows = []
    for n in range(4, 14):
        for k in range(1, 40):
            phrases = [prose(rng, n) for _ in range(k % 6 + 1)]
            rows.append((len(rows), " ".join(f"{rng.choice(phrases)} {prose(rng, rng.randint(k // 2 + 1, k + 12))}" for _ in range(12))))
    rows += [(len(rows), "# $ % " * 5 + prose(rng, 30)), (len(rows) + 1, "\n".join([prose(rng, 9)] * 3 + [prose(rng, 9) for _ in range(9)]))]
    failed_alone = set()
    for r in repetition.repetition_rules(spark.createDataFrame(rows, DOCS)).collect():
        n_words, _, n_symbols, _, _, base = B.rules(r["text"])
        bad = {f"{n}grams" for n, most in repetition.DUPLICATE_NGRAMS.items() if B.repeated_chars(r["text"], n) > most}
        bad |= {name for name, x in (("base", base), ("lines", B.repeated_line_chars(r["text"]) > repetition.DUPLICATE_LINES), ("symbols", n_symbols > repetition.SYMBOLS_PER_WORD * n_words)) if x}
        assert set(filter(None, r["failed_rules"].split(","))) == bad and r["kept"] == (not bad)
        failed_alone |= bad if len(bad) == 1 else set()
    assert {f"{n}grams" for n in (5, 10)} <= failed_alone


def test_decontamination(spark, docs, texts):
    long = texts[10].split()
    items = [("a", " ".join(long[:25]).upper()), ("b", "one, two... THREE four"), ("c", ""), ("d", None), (None, "Ünïcödé wörds"), ("a", texts[12]), ("e", "x" * 5000), ("f", "never seen at all")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = B.by_key((i, B.benchmark(t, items)) for i, t in [*enumerate(texts), (None, texts[9]), (9, texts[9]), (9, texts[9])])
    for block in (decontamination.BLOCK_BYTES, 4000):
        rows = decontamination.find_benchmark(docs.withColumn("n_words", F.lit("x")), bench, block_bytes=block).collect()
        assert B.by_key((r["doc_id"], (r["n_words"], sorted(r["hit_words"]), sorted(r["hit_items"]))) for r in rows) == want
    clean = decontamination.decontaminate(clashing(docs), bench)
    assert clean.columns == clashing(docs).columns and clean.count() == sum(not v[2] for vs in want.values() for v in vs)
    assert decontamination.find_benchmark(docs, bench.limit(0)).where("size(hit_items) > 0").count() == 0 and decontamination.find_benchmark(docs.limit(0), bench).count() == 0


# 4
PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>First  paragraph\nof the text, long enough to be the content of it all.</p><p>Short.</p><div class='ad-box'>Buy</div></article><footer>Imprint</footer></body></html>", "Title & more\nFirst paragraph of the text, long enough to be the content of it all.\nShort."),
    ("<body><div id=sidebar>links links</div><div id=content><p>Some words that are the article here, quite a lot.<p>And more words &#8212; unclosed<script>var x = '<p>no</p>'</script></div><div class=comments><p>A reader writes a very long comment that nobody wants to read in here.</div></body>", "Some words that are the article here, quite a lot.\nAnd more words — unclosed"),
    ("", ""), (None, ""), ("<html><head><title>t</title></head><body></body></html>", ""), ("plain text only", "plain text only"), ("<p>" + "<b>" * 3000 + "deep" , "deep"),
    ("<article><p>Value of <math>x</math> is <button>Copy</button>given.<script>a</script></article>", "Value of x is given."),
    ("<body><article><p>One article here.</p></article><article><p>And one more.</p></article><footer>Imprint</footer>", "One article here.\nAnd one more."),
    ("<article><header><h1>Own head</h1></header><p>Text.</p><aside>Aside</aside><div class='comments'><p>A comment.</div></article>", "Own head\nText."),
]
LONG = "So this sentence is long enough to be taken for the content of the page by its ratio of text to tags, and by nothing else. "


def generated_page(rng):
    """A page and its main text."""
    said, html = [], []
    if rng.random() < 0.7:
        html.append(rng.choice(["<header><a href=/>Site</a></header>", "<nav><ul><li><a href=1>Home<li><a href=2>News</ul></nav>", "<div class='top-nav'>Go to content</div>"]))
    if rng.random() < 0.5:
        html.append(rng.choice(["<div class='cookie-notice'>We use cookies</div>", "<div id=ad-1>Buy now, it is cheap</div>", "<form><label>Name</label><input></form>", "<style>p{}</style>"]))
    inner = []
    for _ in range(rng.randint(2, 7)):
        kind = rng.randrange(6)
        if kind == 0:
            text = prose(rng, 4)
            inner.append(f"<h2>{text}</h2>")
        elif kind == 1:
            items = [prose(rng, 5) for _ in range(3)]
            inner.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
            said += items
            continue
        elif kind == 2:
            text = LONG.strip() + " & " + prose(rng, 6)
            inner.append(f"<p>{text.replace('&', '&amp;')}")
        elif kind == 3:
            text = (LONG * 3).strip()
            inner.append(f"<section class='related-work'><p>{text}</p></section>")
        elif kind == 4:
            text = f"{prose(rng, 20)} {LONG}{prose(rng, 3)}"
            inner.append(f"<p>{text.replace(' ', chr(10), 2)}<script>var x = '</p>'</script></p>")
        else:
            text = f"{LONG}See figure 1."
            inner.append(f"<div><b>{text[:30]}</b>{text[30:]}</div>")
        said.append(text)
    shape = rng.randrange(3)
    if shape == 2 and not any(len(x) > 100 for x in said):
        inner.append(f"<p>{LONG}</p>")
        said.append(LONG.strip())
    html += {0: ["<article>", *inner, "</article>"], 1: ["<div class='page with-sidebar'><main>", *inner, "</main></div>"], 2: ["<article class='entry social-policy'><div>", *inner, "</div></article>"]}[shape]
    if rng.random() < 0.6:
        html.append(rng.choice(["<aside>More to read</aside>", "<div class=comments><p>" + LONG + "</div>", "<div class=share>Share this</div>", "<footer>&copy; 2020</footer>"]))
    return "<html><body>" + "".join(html) + "</body></html>", "\n".join(said)


def test_html_of_generated_pages(spark):
    rng = random.Random(16)
    pages = [generated_page(rng) for _ in range(300)]
    big = "".join(f"<p>{LONG}</p>" for _ in range(12_000))
    pages += [(f"<nav>x</nav><article>{big}</article>", "\n".join([LONG.strip()] * 12_000)), ("<article><p>x</p></article><!-- " + "a " * 1_000_000, "x")]
    found = {r["i"]: r["main_text"] for r in html_extraction.extract_main_text(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "i int, html string")).collect()}
    for i, (h, text) in enumerate(pages):
        assert found[i] == text, h[:3000]


A, Z = ("Rivers carry more silt after a wet spring than farmers along the banks remember from any year before, and the mills had to stop twice. " * 3).strip(), ("Nobody in the valley had kept count of the floods until a schoolteacher began to mark them on the wall beside the old bridge each year. " * 3).strip()
ASIDE = "<nav><a href=/>Home</a> <a href=/n>News</a></nav>"
NAMED_PAGES = [
    (f'<body class="single comments-open">{ASIDE}<article><p>{A}</p><p>{Z}</p></article></body>', [A, Z]),
    (f'<body>{ASIDE}<article class="post comments-closed"><p>{A}</p><p>{Z}</p></article></body>', [A, Z]),
    (f'<body>{ASIDE}<div class="content-with-sidebar"><p>{A}</p><p>{Z}</p></div></body>', [A, Z]),
    (f'<body>{ASIDE}<div id="newsletter-issue"><p>{A}</p><p>{Z}</p></div></body>', [A, Z]),
    (f'<body>{ASIDE}<div class="sidebar"><p>{A}</p><p>{Z}</p></div></body>', [A, Z]),
    (f'<body><form id="aspnetForm"><input type=hidden name=s>{ASIDE}<div><label>Find</label><input name=q></div><div><p>{A}</p><p>{Z}</p></div></form></body>', [A, Z]),
    (f'<body>{ASIDE}<article><p>{A}</p><p class="reply">Not so, said the miller.</p><p>{Z}</p></article></body>', [A, "Not so, said the miller.", Z]),
    (f'<body>{ASIDE}<article><p>{A}</p><section class="ad-history"><p>{Z}</p></section></article></body>', [A, Z]),
    (f'<body>{ASIDE}<div><article><p>{A}</p></article></div><div><article><p>{Z}</p></article></div></body>', [A, Z]),
    (f'<body>{ASIDE}<article><p>{A}</p><footer><p>{Z}</p></footer></article></body>', [A, Z]),
    (f'<body>{ASIDE}<article><p>{A}</p><footer>Filed under rivers</footer></article><footer>Imprint</footer></body>', [A]),
    (f'<body><article><p>{A}</p><p style="color:red; display: none">Unseen</p><p>{Z}</p></article></body>', [A, Z]),
    (f'<body><article><p>{A}</p><form><label>Mail</label><input><p>Get our letter</p><button>Go</button></form><p>{Z}</p></article></body>', [A, Z]),
    (f'<body><article><p>{A}</p></article><div class="comment-list"><div class=comment><p>{Z}</p></div><article class="comment"><p>{Z}</p></article></div><article class="comment"><p>{Z}</p></article></body>', [A]),
    (f'<body><article><p>{A}</p><div class="ad-box"><p>{Z}</p></div><p>{Z}</p></article><aside>{A}</aside></body>', [A, Z]),
]


@pytest.mark.parametrize("html, lines", NAMED_PAGES)
def test_no_article_is_lost_by_a_name(html, lines):
    assert html_extraction.main_text(html) == "\n".join(lines)



def test_html_extraction(spark):
    df = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id int, url string, html string, MAIN_TEXT string")
    found = {r["page_id"]: r["main_text"] for r in html_extraction.extract_main_text(df).collect()}
    assert found == {i: t for i, (_, t) in enumerate(PAGES)}
    assert html_extraction.extract_main_text(df.limit(0)).count() == 0


# 5
def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["b", "a", "a", "a", "", None, "é"]), " ".join(["w"] * int(rng.paretovariate(0.9) * 3))) for i in range(4000)]
    rows += [(4000, "a", None), (4001, "a", ""), (None, "b", "w w"), (5, "b", "w w w"), (4002, "lone", "w " * 700), (4003, "void", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(B.SPACED.findall(t or ""))
    want = B.targets(size)
    for s in size:
        mine = [r for r in found if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size[s]} and all(math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9) for r in mine)
        assert sum(r["size"] for r in mine) == size[s] and all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        slack = max(20, 0.01 * want[s], max(r["size"] for r in mine) if len(mine) < 50 or max(r["size"] for r in mine) > 0.1 * size[s] else 0)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= slack, (s, sum(r["taken"] for r in mine), want[s])
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found)) and mixing.mix(df.limit(0)).count() == 0


def test_mixing_is_unbiased(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", "w " * (1 + i % 9)) for i in range(600)], "doc_id long, source string, text string")
    total = {}
    for seed in range(6):
        for r in mixing.mix(df, seed=seed).collect():
            total.setdefault(r["source"], []).append((r["taken"], r["size"], r["target"] / r["source_size"]))
    for rows in total.values():
        for k in (1, 5, 9):  # documents of each size get their share
            mine = [(t, n, q) for t, n, q in rows if n == k]
            assert abs(sum(t for t, _, _ in mine) / sum(n * q for _, n, q in mine) - 1) < 0.12


# 6
def labelled(rng, n=900):
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, 60).split()
        bad = i % 9 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["vile", "nasty", "awful"])
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, 0 if bad and i % 4 == 1 else 1, int(bad)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality(spark):
    rows, labels = labelled(random.Random(9), 1800)
    rows += [(2000, None), (2001, ""), (None, "plain words"), (3, rows[3][1])]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], LABELS)
    found = quality.resample(clashing(df), lab).collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    held = [i for i in range(1800) if i % 2 == 0]
    assert sum(kept[i] for i in held if i % 9) / sum(1 for i in held if i % 9) > 0.97 and sum(kept[i] for i in held if i % 9 == 0) <= 0.1 * sum(1 for i in held if i % 9 == 0)
    assert kept[2000] and kept[2001] and len(found) == len(rows)
    out = quality.keep_quality(spark, clashing(df), lab)
    assert out.columns == clashing(df).columns and out.count() == sum(r["kept"] for r in found)
    assert quality.resample(df, lab.limit(0)).where("not kept").count() == 0 and quality.resample(df.limit(0), lab).count() == 0
    again = quality.resample(df.repartition(7), lab).collect()
    assert sorted((str(r["doc_id"]), round(r["log_weight"], 9), r["kept"]) for r in again) == sorted((str(r["doc_id"]), round(r["log_weight"], 9), r["kept"]) for r in found)


def test_quality_against_brute_force(spark):
    """Weights from counts of buckets in plain Python; the sample as the largest keys, for a share that cuts among likes too."""
    import pyarrow as pa

    rng = random.Random(19)
    rows, labels = labelled(rng)
    target = {i for i, q, t in labels if q == 1 and t == 0}
    rows += [(3000 + i, rows[2][1]) for i in range(40)]  # copies of one text, none of them labelled
    copies = {t: sum(x == t for _, x in rows) for _, t in rows}
    of = {}
    for i, t in rows:
        tables, _, _, _ = quality.features(pa.array([t], pa.large_string()))
        of[i] = [[k * quality.SIZE + b for b in x.tolist()] for k, x in enumerate(tables)]
    raw, good = {}, {}
    for i, t in rows:
        one = round(quality.UNIT / copies[t]) / quality.UNIT
        for b in (b for table in of[i] for b in table):
            raw[b] = raw.get(b, 0) + one
            good[b] = good.get(b, 0) + one * (i in target)
    log = {}
    for k in range(quality.WORD_TABLES + quality.PAIR_TABLES):
        mine = sorted((b for b in raw if b // quality.SIZE == k), key=lambda b: good[b] / raw[b])
        half, run = sum(raw[b] for b in mine) / 2, 0.0
        for b in mine:
            run += raw[b]
            if run >= half:
                break
        bulk = good[b] / raw[b] or sum(good[b] for b in mine) / sum(raw[b] for b in mine)
        for b in mine:
            e, g = raw[b] * bulk, good[b]
            evidence = e - g + (g * math.log(g / e) if g else 0)
            log[b] = math.log((g + quality.KAPPA) / (e + quality.KAPPA)) / (1 + math.exp(quality.AGAINST - evidence))
    want = {}
    for i, tables in of.items():
        sides = tables[: quality.WORD_TABLES], tables[quality.WORD_TABLES :]
        want[i] = sum(min((log[b] for b in same), key=abs) for side in sides for same in zip(*side, strict=True))
    assert min(want.values()) < -5 and max(want.values()) > 0
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    for share in (None, 0.5):
        found = quality.resample(df, lab, share=share).collect()
        assert all(math.isclose(r["log_weight"], want[r["doc_id"]], rel_tol=1e-6, abs_tol=1e-6) for r in found)
        k = round(sum(math.exp(min(0, w - quality.ENVELOPE)) for w in want.values()) if share is None else share * len(rows))
        least = sorted((r["gumbel_key"] for r in found), reverse=True)[k - 1]
        assert all(r["kept"] == (r["gumbel_key"] >= least) for r in found)
        noise = [r["gumbel_key"] - r["log_weight"] for r in found]
        assert abs(sum(noise) / len(noise) - 0.5772) < 0.15  # a Gumbel variable's mean
    inside = sorted(r["log_weight"] for r in found if r["kept"])
    outside = sorted(r["log_weight"] for r in found if not r["kept"])
    assert inside[0] < outside[-1]  # no threshold: the draw decides among likes


def test_labels_are_taken_in_whole_bins(spark):
    lab = spark.createDataFrame([(i, 1, 0) for i in range(3000)], LABELS)
    assert quality.target_ids(lab, 10_000).count() == 3000 and 950 < quality.target_ids(lab, 1000).count() <= 1000


def test_kth_largest(spark):
    values = [float(x) for x in random.Random(1).choices(range(-50, 50), k=3000)] + [1e6, -1e6]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 700, 3002, 4000):
        assert quality.kth_largest(df, k, bins=16, few=50) == sorted(values, reverse=True)[min(k, 3002) - 1]


# 7
@pytest.mark.parametrize("crowd", [4096, 3])
def test_suffix_dedup(spark, texts, crowd):
    rows = list(enumerate(texts)) + [(500, texts[9]), (501, texts[12][5:] + " tail"), (502, "abcdefgh" * 40)]
    want = {i: w for (i, _), w in zip(rows, B.repeats([t for _, t in rows], 60), strict=True)}
    found = suffix_dedup.cut_repeats(spark.createDataFrame(rows, DOCS).repartition(5), length=60, crowd=crowd).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_text"])) for r in found} == want


def test_suffix_dedup_at_full_length(spark):
    rng = random.Random(8)
    shared = [prose(rng, 90 + 10 * i) for i in range(4)]
    rows = [(i, f"{prose(rng, 30 + i)} {shared[i % 4]} {prose(rng, 20)}{' ' + shared[i % 4] if i % 7 == 0 else ''}") for i in range(24)] + [(90, "z" * 1300), (91, shared[0][:399]), (92, None)]
    want = B.repeats([t for _, t in rows], 400)
    df = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r for r in suffix_dedup.cut_repeats(df).collect()}
    assert [(found[i]["n_bytes"], found[i]["n_removed"], found[i]["n_spans"], bytes(found[i]["kept_text"])) for i, _ in rows] == want
    left = suffix_dedup.without_repeats(df.withColumn("n_chars", F.char_length("text")).withColumn("n_bytes", F.lit(1)))
    assert left.columns == ["doc_id", "text", "n_chars", "n_bytes"] and all(r["n_chars"] == len(r["text"]) for r in left.where("text is not null").collect())
    assert {r["doc_id"] for r in left.collect()} == {i for (i, _), w in zip(rows, want, strict=True) if w[3] or not w[0]}
    assert suffix_dedup.cut_repeats(df.limit(0)).count() == 0


def test_suffix_dedup_of_periodic_and_long_texts(spark):
    """Texts of megabytes with one byte or a period of 8, and a passage near the end of another long text."""
    rng = random.Random(21)
    long = " ".join(prose(rng, 1000) + f" {i}" for i in range(130))
    passage = prose(rng, 120)
    rows = [(1, "z" * (8 << 20)), (2, "abcdefgh" * (1 << 20)), (3, f"{long} {passage} end"), (4, f"start {passage}"), (5, "q" * 399 + "z" * 450), (6, "z" * 399)]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_text"])) for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(rows[2][1]) > 500_000
    assert found[1] == (8 << 20, 8 << 20, 1, b"") and found[2] == (8 << 20, 8 << 20, 1, b"")
    own = f" {passage}"  # the blank before it is shared too
    for i, text in (rows[2], rows[3]):
        kept = text.replace(own, "").encode()
        assert found[i] == (len(text), len(own), 1, kept)
    assert found[5] == (849, 450, 1, b"q" * 399) and found[6] == (399, 0, 0, b"z" * 399)


def test_copies_carry_no_spans(spark):
    """What repeats in a text that occurs again isn't sent to each of its copies."""
    rng = random.Random(27)
    shared = prose(rng, 120)
    text = f"{prose(rng, 40)} {shared} {prose(rng, 20)}"
    rows = [(i, text) for i in range(5)] + [(9, f"{prose(rng, 30)} {shared}")]
    df = spark.createDataFrame(rows, DOCS)
    found = suffix_dedup.repeats(df).collect()
    assert sorted((r["whole"], len(r["spans"] or ()) > 0) for r in found) == [(False, True), (True, False)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_text"]), r["left_text"]) for r in suffix_dedup.cut_repeats(df, left_text=True).collect()}
    assert got == {i: (*w, w[3].decode()) for (i, _), w in zip(rows, B.repeats([t for _, t in rows], 400), strict=True)}


def test_suffix_arrays_by_brute_force():
    import numpy as np

    rng = random.Random(22)
    said = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    sizes = np.array([len(x) for x in said])
    data = np.frombuffer(b"".join(said), np.uint8)
    a = suffix_dedup.Array(suffix_dedup.table_of(data, np.cumsum(sizes) - sizes, sizes, 9, 1))
    assert [said[i] for i in a.order] == sorted(said)
    common = [next((k for k, (x, y) in enumerate(zip(said[i], said[j], strict=False)) if x != y), min(len(said[i]), len(said[j]))) for i, j in zip(a.order, a.order[1:], strict=False)]
    assert a.common.tolist() == common


def test_passages_of_few_words_stay(spark):
    rng = random.Random(23)
    few, many = prose(rng, 45), prose(rng, 60)
    rows = [(i, f"{prose(rng, 30)} {few if i % 2 else many} {prose(rng, 30)}") for i in range(8)]
    left = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, DOCS), length=200, least_words=50).collect()}
    assert all(left[i] == t if i % 2 else many not in left[i] and len(left[i].split()) in (59, 60, 61) for i, t in rows)


def test_characters_are_cut_whole(spark):
    rows = [(i, f"{i}" + "äöü" * 300 + f"{i}") for i in range(2)] + [(9, "é" * 10)]
    for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, DOCS)).collect():
        assert re.fullmatch("[01äöüé]*", r["text"])


# 9
def test_lm_scoring(spark, docs, texts):
    rows = [*enumerate(texts), (None, texts[9]), (9, texts[9]), (9, texts[9])]
    found = pitman_yor.score_texts(docs, head=20, known_words=30).collect()
    got = B.by_key((r["doc_id"], (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in found)
    assert got == B.by_key((i, (h, n, k, t, round(b, 6))) for i, h, n, k, t, b in B.lm_base(rows))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    same = pitman_yor.score_texts(docs, head=20, known_words=2).collect()  # most words through the join instead of the broadcast
    assert B.by_key((r["doc_id"], round(r["score"], 6)) for r in same) == B.by_key((r["doc_id"], round(r["score"], 6)) for r in found)


def test_lm_learns_what_follows_what(spark):
    rng = random.Random(6)
    chain = {w: rng.sample("ab cd ef gh ij kl mn op".split(), 2) for w in "ab cd ef gh ij kl mn op".split()}

    def walk():
        out = ["ab"]
        while len(out) < 30:
            out.append(rng.choice(chain[out[-1]]))
        return " ".join(out)

    df = spark.createDataFrame([(i, walk()) for i in range(400)], DOCS)
    r = pitman_yor.score_texts(df).where("held_out").agg(F.avg("score"), F.avg("base_score"), F.avg("perplexity")).first()
    assert r[0] > r[1] * 0.55 and r[2] < 3
    empty = pitman_yor.score_texts(df.limit(0))
    assert empty.count() == 0
    untrained = pitman_yor.score_texts(df.limit(3), held_out=F.lit(True)).collect()
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 0 and r["n_known"] == 0 for r in untrained)


def test_predictive_probabilities_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(1)
    c = pitman_yor.Contexts(rng.poisson(0.7, (12, 12)))
    for _ in range(3):
        assert np.allclose(c.predictive().sum(1), 1)
        c.sweep(rng)
        assert (c.tables <= c.counts).all() and ((c.tables > 0) == (c.counts > 0)).all()


def test_draws_of_the_seating():
    import numpy as np

    rng = np.random.default_rng(5)
    u, v = rng.random(100_000), rng.random(100_000)
    for n, p in ((100, 0.01), (1000, 0.02), (40, 0.4), (500_000, 4e-5), (5000, 0.3), (10, 0.9), (7, 1.0), (9, 0.0), (0, 0.5)):
        x = pitman_yor.binomial(u, v, np.full(len(u), n), np.full(len(u), p))
        sd = math.sqrt(n * p * (1 - p))
        assert abs(x.mean() - n * p) <= 0.02 * sd + 0.08 and abs(x.std() - sd) <= 0.02 * sd + 0.07 and x.min() >= 0 and x.max() <= n
    customers = rng.integers(1, 4000, 3000)
    weight = rng.random(3000) * 4
    hashed = pitman_yor.seat_by_hash(customers, weight, 0.6, rng.integers(0, 2**63, 3000).astype(np.uint64), 1)
    one_by_one = pitman_yor.seat(customers, weight, 0.6, rng)
    assert (hashed >= 1).all() and (hashed <= customers).all() and abs(hashed.mean() / one_by_one.mean() - 1) < 0.06


def test_lm_learns_pairs_of_rare_words(spark):
    """More than 512 words are commoner than those of the pairs; each of these stands twice in training texts."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(600)]
    rows = [(i, " ".join(common[(i * 7 + j) % 600] for j in range(60))) for i in range(0, 100)]
    pairs = [(f"left{i}", f"right{i}") for i in range(120)]
    filler = lambda: " ".join(rng.choice(common) for _ in range(4))
    rows += [(1000 + k * 120 + i, f"{filler()} {a} {b}") for k in range(2) for i, (a, b) in enumerate(pairs)]
    same = [(5000 + i, f"{a} {b}") for i, (a, b) in enumerate(pairs)]
    crossed = [(6000 + i, f"{a} {pairs[(i + 1) % 120][1]}") for i, (a, _) in enumerate(pairs)]
    df = spark.createDataFrame(rows + same + crossed, DOCS)
    for known, head in ((200_000, 300_000), (20, 10)):
        found = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(df, held_out=F.col("doc_id") >= 5000, known_words=known, head=head).collect()}
        gain = [found[5000 + i] - found[6000 + i] for i in range(120)]
        assert min(gain) > 1 and len(found) == len(rows) + 240


def test_scores_do_not_depend_on_the_layout(spark, docs):
    """Draws come from words and contexts, so partitions and batches don't matter."""
    found = [B.by_key((r["doc_id"], round(r["score"], 7)) for r in pitman_yor.score_texts(docs.repartition(n), known_words=40, head=30).collect()) for n in (1, 7)]
    assert found[0] == found[1]


def test_lm_writes_no_row_per_token(spark, monkeypatch):
    """Tokens that wait for a word or a pair go packed; tables hold words and pairs only, however often they occur."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(100)], DOCS)
    rows = []

    def counted(table, what):
        out = frames_written(table, what)
        rows.append((out.count(), what))
        return out

    frames_written = pitman_yor.written
    monkeypatch.setattr(pitman_yor, "written", counted)
    assert pitman_yor.score_texts(df, known_words=5, head=3, sweeps=2, burn_in=1).count() == 100
    assert max(rows)[0] <= 61 * 61 + 61 < 30_100, max(rows)


def test_lm_keeps_pairs_packed(spark, monkeypatch):
    """Sweeps move a few packed rows for each bucket, not one for each pair."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(100)], DOCS)
    rows, frames_written = [], pitman_yor.written

    def counted(table, what):
        out = frames_written(table, what)
        if what == "lm-many":
            rows.append((out.count(), out.agg(F.sum("pairs")).first()[0] if "pairs" in out.columns else None))
        return out

    monkeypatch.setattr(pitman_yor, "written", counted)
    assert pitman_yor.score_texts(df, known_words=30, head=3, sweeps=2, burn_in=1).count() == 100
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(rows) == 2 and all(count <= 4 * n and pairs > 2000 for count, pairs in rows), rows


def test_order_and_places_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**64, 5000, np.uint64)
    near = (hashes[:40, None] + np.arange(9, dtype=np.uint64)[::-1]).ravel()  # differ in their last bits alone
    for keys in (hashes, np.concatenate([hashes, hashes[:2000], near, near]), hashes % np.uint64(50), hashes >> np.uint64(30), near, near[:9], hashes[:1], hashes[:0], np.arange(9000, dtype=np.uint64) % np.uint64(4000) + np.uint64(2**64 - 4001)):
        order, cuts = pitman_yor.groups(keys)
        assert sorted(order.tolist()) == list(range(len(keys))) and (keys[order] == np.sort(keys)).all()
        assert (keys[order][cuts] == np.unique(keys)).all()
        known = np.unique(keys)[::2]
        wanted = np.concatenate([keys, keys + np.uint64(1), hashes[:100], np.array([0, 2**64 - 1], np.uint64)])
        at, found = pitman_yor.Places(known).find(wanted)
        assert (found == np.isin(wanted, known)).all() and (not len(known) or (known[at[found]] == wanted[found]).all())


# 2, 3, 6, 8, 9, 10 with texts of megabytes
def test_texts_of_megabytes(spark):
    rng = random.Random(31)
    phrase = "under the mit license"
    item = prose(rng, 12)
    long = " ".join(f"{prose(rng, 4000)} {i}" for i in range(60))
    assert len(long) > 1_200_000
    texts = [f"{long} {phrase} {item}", f"{long} {phrase} {item} tail", None, "a few words", prose(rng, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(2)
    got = {r["doc_id"]: r["component_id"] for r in sketch_join.jaccard_components(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"]) for r in licenses.scan_licenses(df).collect()} == {i: (w[0], w[1], w[2]) for i, w in enumerate(map(B.licenses, texts))}
    assert {r["doc_id"]: r["n_words"] for r in repetition.repetition_rules(df).collect()} == {i: len((t or "").split()) for i, t in enumerate(texts)}
    found = decontamination.find_benchmark(df, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()
    assert {r["doc_id"]: list(r["hit_items"]) for r in found} == {0: ["a"], 1: ["a"], 2: [], 3: [], 4: []}
    grams = {r["doc_id"]: r["n_grams"] for r in quality.resample(df, spark.createDataFrame([(0, 1, 0)], LABELS)).collect()}
    words = [(t or "").lower().split() for t in texts]
    assert grams == {i: len(set(w)) + len(set(zip(w, w[1:], strict=False))) for i, w in enumerate(words)}
    scored = {r["doc_id"]: r["n_tokens"] for r in pitman_yor.score_texts(df, held_out=F.col("doc_id") > 2).collect()}
    assert scored == {i: len(w) + 1 for i, w in enumerate(words)}
    size = {r["doc_id"]: r["size"] for r in mixing.mix(df.withColumn("source", F.lit("a"))).collect()}
    assert size == {i: len(w) for i, w in enumerate(words)}


def rest_of(df):
    """What the rest stage takes, with every class a component of its own."""
    members = sketch_join.named_sets(df, "text", "doc_id")
    cells = ["n_shingles", "own_band", "own_cells", "next_cells"]
    classes = members.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least_doc"), *(F.first(c).alias(c) for c in cells))
    strong = sketch_join.written(sketch_join.strong_cells(sketch_join.shared_cells(df, "text", 4), classes), "t")
    sets = sketch_join.written(sketch_join.sets_of(df, "text", strong.select("id").distinct()), "t")
    return members, strong, strong.select("id", F.col("id").alias("component")).distinct(), sets


@pytest.mark.parametrize("share", [70, 80, 86, 88])
def test_boilerplate_is_not_compared_in_pairs(spark, share):
    """Texts of like length of which a share is the same: nobody is linked, and nobody meets another in the rest."""
    rng = random.Random(share)
    same = prose(rng, 2 * share)
    rows = [(i, f"{same} {prose(rng, 200 - 2 * share)}") for i in range(300)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sketch_join.rest_pairs(*rest_of(df)[1:]).count() == 0
    assert all(r["component_id"] == r["doc_id"] for r in sketch_join.jaccard_components(df).collect())


def test_pairs_around_a_boilerplate_grow_in_proportion(spark):
    """Nine tenths of every text stand elsewhere too: 84 % in all texts, the rest in passages of few. Pairs are as many for each text in a table twice as large."""
    found = []
    for n in (150, 300):
        rng = random.Random(5)
        same, passages = prose(rng, 252), [prose(rng, 9) for _ in range(n // 5)]
        rows = [(i, " ".join([same, *rng.sample(passages, 4), prose(rng, 8)])) for i in range(n)]
        df = spark.createDataFrame(rows, DOCS).repartition(3)
        _, strong, alone, sets = rest_of(df)
        found.append(sketch_join.rest_pairs(strong, alone, sets).count() / n)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sketch_join.jaccard_components(df).collect()} == B.jaccard(rows)
    assert found[1] <= 1.5 * found[0] + 1


@pytest.mark.parametrize("few", [1, 4, 64])
def test_the_rest_alone_finds_every_link(spark, monkeypatch, few):
    """Without any round before: links of copies, of parts, of texts around boilerplates and of short texts, for each bound of what few classes have."""
    monkeypatch.setattr(sketch_join, "FEW", few)
    rng = random.Random(41)
    rows, boiler = [], [prose(rng, 60), prose(rng, 110)]
    for g in range(12):
        w = prose(rng, 12 + 14 * g).split()
        for k in range(8):
            w = list(w)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((len(rows), " ".join(w[: len(w) - rng.randint(0, max(1, len(w) // 9))])))
    rows += [(len(rows) + i, f"{boiler[i % 2]} {prose(rng, rng.randint(1, 14))}") for i in range(50)]
    rows += [(len(rows) + i, prose(rng, 1 + i % 9)) for i in range(30)]
    members, strong, alone, sets = rest_of(spark.createDataFrame(rows, DOCS).repartition(3))
    sets_by = {r["set_id"]: B.shingles(rows[r["doc_id"]][1]) for r in members.where("n_shingles > 0").collect()}
    names = sorted(sets_by)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 100 * len(sets_by[a] & sets_by[b]) >= 80 * len(sets_by[a] | sets_by[b])}
    got = {(r["a"], r["b"]) for r in sketch_join.linked(sketch_join.rest_pairs(strong, alone, sets), sets).collect()}
    assert got == want and len(want) > 200
