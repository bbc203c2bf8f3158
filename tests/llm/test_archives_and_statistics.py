"""Operators 11 to 13 against brute force."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import prose
from tidemark.llm import divergence, warc, whitening

PAGES = "page_id long, url string, html string"


# 11
def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records_by_brute_force(rows, least=0):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(-math.inf if i is None else i)
    out = []
    for payload, ids in groups.items():
        best = max(ids)
        for k, i in enumerate(sorted(ids, reverse=True)):
            revisit = k > 0 and len(payload) >= least
            out.append((None if i == -math.inf else str(int(i)), len(payload), digest(payload), "revisit" if revisit else "response", str(int(best)) if revisit and best != -math.inf else None))
    return sorted(out, key=str)


def found_records(chunks):
    rows = warc.read_records(chunks).collect()
    assert all(r["intact"] for r in rows) and len({r["record_id"] for r in rows}) == len(rows)
    return sorted(((r["source_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    bits = ["\r\n", "\r", "\n", "WARC/1.1\r\n", "0\r\n\r\n", "7\r\n", "ü", "😀", "\x00", "Content-Length: 3\r\n\r\n", "a", "<p>", "\r\n\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(120)] + [None, "", prose(rng, 4000)]
    rows = [(i, rng.choice([None, "http://a/ü b\r\nX: y", f"http://h/{i}"]), rng.choice(texts)) for i in range(200)]
    return rows + [(None, None, texts[3]), (None, "http://n", texts[3]), rows[7], (7, "http://other", rows[7][2])]


@pytest.mark.parametrize(("chunk", "compression", "least"), [(1, "gzip", 0), (7, "none", 4), (1 << 20, "gzip", 60)])
def test_archives_are_read_back(spark, tmp_path, pages, chunk, compression, least):
    df = spark.createDataFrame(pages, PAGES).withColumn("record", F.lit("x")).withColumn("Data", F.lit(1)).repartition(5)
    warc.archive(df, str(tmp_path / "w"), least_bytes=least, chunk_bytes=chunk, compression=compression)
    chunks = warc.read_chunks(spark, str(tmp_path / "w"), splittable=compression == "none").cache()
    assert found_records(chunks) == records_by_brute_force(pages, least)
    parts = defaultdict(dict)
    for r in chunks.where("record_type = 'response'").collect():
        assert len(r["data"]) <= chunk
        parts[r["record_id"]][r["chunk_no"]] = r
    for p in parts.values():  # the chunks are the payload, and carry its digests
        payload = b""
        for k in range(len(p)):
            payload += bytes(p[k]["data"])
            assert (p[k]["bytes_so_far"], p[k]["digest_so_far"]) == (len(payload), digest(payload))
    assert {digest(b"".join(bytes(p[k]["data"]) for k in range(len(p)))) for p in parts.values()} == {digest((t or "").encode()) for *_, t in pages}


def test_archives_follow_the_format(spark, tmp_path, pages):
    """Records are found by Content-Length alone, and the blocks are HTTP messages."""
    warc.archive(spark.createDataFrame(pages, PAGES), str(tmp_path / "w"), chunk_bytes=50, date="2024-01-02T03:04:05Z")
    seen = Counter()
    for f in (tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *fields = head.decode("ascii").split("\r\n")
            fields = dict(x.split(": ", 1) for x in fields)
            assert version == "WARC/1.1" and fields["WARC-Date"] == "2024-01-02T03:04:05Z" and " " not in fields["WARC-Target-URI"]
            block, data = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
            assert data.startswith(b"\r\n\r\n")
            data = data[4:]
            http, _, body = block.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK")
            seen[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] == "revisit":
                assert not body and fields["WARC-Profile"].endswith("identical-payload-digest") and fields["WARC-Refers-To"].startswith("<urn:uuid:")
                continue
            payload = b""
            while True:
                size, _, body = body.partition(b"\r\n")
                if not (n := int(size, 16)):
                    break
                payload, body = payload + body[:n], body[n + 2 :]
            assert body == b"\r\n" and fields["WARC-Payload-Digest"] == "sha1:" + digest(payload)
    assert seen == Counter(r[3] for r in records_by_brute_force(pages))


def test_other_writers_archives(spark, tmp_path):
    """Members compressed one by one, blocks without transfer coding, records that have no response."""
    body = b"<p>\r\none\r\n\r\ntwo</p>"
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    made = [(b"warcinfo", b"application/warc-fields", b"software: x\r\n"), (b"response", b"application/http; msgtype=response", http), (b"resource", b"text/plain", body + b"\r\n"), (b"response", b"application/http", b"HTTP/1.1 204 No\r\n\r\n"), (b"resource", b"text/plain", b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.0\r\nWARC-Type: %b\r\nWARC-Record-ID: <urn:%d>\r\nContent-Type: %b\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (t, k, kind, len(b), b)) for k, (t, kind, b) in enumerate(made)))
    chunks = warc.read_chunks(spark, str(tmp_path / "*.warc.gz"))
    got = {r["record_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.read_records(chunks).collect()}
    want = [body, body + b"\r\n", b"", b""]
    assert got == {f"<urn:{k + 1}>": (len(x), digest(x)) for k, x in enumerate(want)}


def test_broken_archives_are_errors(spark, tmp_path):
    for k, text in enumerate([b"no record\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n", b"WARC/1.1\r\nContent-Type: application/http\r\nContent-Length: 60\r\n\r\nHTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nabcd\r\n"]):
        (tmp_path / f"{k}.gz").write_bytes(gzip.compress(text))
        with pytest.raises(Exception, match="record|ends within|longer"):
            warc.read_chunks(spark, str(tmp_path / f"{k}.gz")).collect()


def test_a_changed_payload_isnt_intact_and_tables_may_be_empty(spark, tmp_path):
    warc.archive(spark.createDataFrame([(1, "u", "good"), (2, "u", "fine")], PAGES), str(tmp_path / "w"), compression="none")
    for f in (tmp_path / "w").glob("part*"):
        f.write_bytes(f.read_bytes().replace(b"good", b"evil"))
        for crc in (tmp_path / "w").glob(".*.crc"):
            crc.unlink()
    assert {r["source_id"]: r["intact"] for r in warc.read_records(warc.read_chunks(spark, str(tmp_path / "w"), splittable=True)).collect()} == {"1": False, "2": True}
    warc.archive(spark.createDataFrame([], PAGES), str(tmp_path / "e"))
    assert warc.read_records(warc.read_chunks(spark, str(tmp_path / "e"))).count() == 0


def test_a_very_long_page(spark, tmp_path):
    rows = [(1, "u", "y" * 9_000_001), (2, "u", "z\r\n" * 1_000_000), (3, "u", "y" * 9_000_001)]
    warc.archive(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), file_bytes=1 << 20)
    chunks = warc.read_chunks(spark, str(tmp_path / "w"))
    assert found_records(chunks) == records_by_brute_force(rows)
    assert chunks.agg(F.max(F.length("data"))).head()[0] <= warc.CHUNK_BYTES and chunks.where("source_id = '1' and not last").count() == 0


# 12
def divergence_by_brute_force(rows, least=3, most=200):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []

    def ranked(lang, source, part, found):
        found.sort(key=lambda x: (-x[1], x[0].encode()))
        out.extend((lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found) if part == "pair" or k < most)

    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(counter, kept=kept):
            n = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            ranked(lang, s, "pair", [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s])
            ranked(lang, s, "term", [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]])
    return sorted(out)


AUDITED = "text string, lang string, source string"


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(12)
    words = [prose(rng, 1) for _ in range(300)] + ["Ünï", "名前", "ÀB", "x" * 300]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words[: rng.choice([5, 60, 304])]).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice([text, text + "9b-c_d", None if i % 40 == 0 else text]), rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "b", "c", None, "é", "z"])))
    return rows + [rows[1]] * 3 + [("single", "rare", "s1"), (None, "rare", "s2"), ("", "rare", "s3"), ("only one", "alone", None)]


@pytest.mark.parametrize(("settle", "most"), [(4096, 200), (1, 7), (3, 1)])
def test_divergence(spark, audited, settle, most):
    df = spark.createDataFrame(audited, AUDITED).repartition(6).withColumn("term", F.lit("x")).withColumn("N", F.lit(2))
    got = sorted(tuple(r) for r in divergence.source_divergence(df, settle=settle, most=most).collect())
    assert got == divergence_by_brute_force(audited, most=most)


def test_divergence_of_long_texts_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 4000)
    monkeypatch.setattr(divergence, "PARTIAL", 100)
    rng = random.Random(2)
    rows = [(prose(rng, 20_000), "en", "a"), (prose(rng, 300) + " " + "q" * 9000, "en", "b"), (prose(rng, 300), "en", "b"), ("-" * 30_000 + "end", "en", "c"), ("end end q", "en", "b"), ("q" * 9000 + " end", "en", "c"), ("q" * 9000, "en", "c")]
    parts = [divergence._counted(__import__("pyarrow").array([t]).cast("large_string"), np.zeros(1, np.int64)) for t, *_ in rows]
    for (t, *_), table in zip(rows, parts, strict=True):
        want = Counter(__import__("re").findall("[a-z]+", t))
        assert dict(zip(table.column("term").to_pylist(), table.column("n").to_pylist(), strict=True)) == want and set(table.column("docs").to_pylist()) == {1}
    assert sorted(tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, AUDITED)).collect()) == divergence_by_brute_force(rows)
    assert divergence.source_divergence(spark.createDataFrame([], AUDITED)).count() == 0


def test_radix_selection(spark):
    rng = random.Random(9)
    rows = [(g, rng.choice([0, 1, 5, 2**31, 2**45 + 7, 2**60 - 1, rng.randrange(2**60)]), rng.choice(["", "a", "aa", "ab"]) + f"ü{i:05d}") for i, g in enumerate(rng.choices("xyz", [200, 30, 5], k=2000))]
    rows += [("hot", 77, "common prefix " * 3 + f"{i:06d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, i string").repartition(5)
    for settle, most in ((1, 50), (40, 3), (4096, 50)):
        got = sorted(tuple(r) for r in divergence.select_top(df, ["g"], "v", "i", most, settle).collect())
        want = []
        for g in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:most]
            want += [(*r, k + 1) for k, r in enumerate(mine)]
        assert got == sorted(want)
    same = spark.createDataFrame([("g", 3, "same")] * 9, "g string, v long, i string")
    assert [r["rank"] for r in divergence.select_top(same, ["g"], "v", "i", 4, 1).collect()] == [1, 2, 3, 4]


# 13
VECTORS = "vec_id long, embedding array<float>"


def whitened_by_brute_force(rows, d, components=32):
    good = [(i, v) for i, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * Fraction(float(np.float32(c)))) + 1000000 for c in v] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = [[n * a - b for a, b in zip(r, s, strict=True)] for r in x]
    c = np.array(off, dtype=float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return [i for i, _ in good], [sum(a * a for a in r) for r in off], c @ u[:, :components] / np.sqrt(np.maximum(e[:components], 1e-300)), e[:components] / e.sum()


def test_whitening(spark):
    rng = np.random.default_rng(3)
    scales = np.geomspace(3, 0.05, 40)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(0, 1, 40) * scales + 5]) for i in range(500)]
    hot = rows[3][1]
    odd = [(900, None), (901, [1.0] * 39 + [None]), (902, [float("nan")] * 40), (903, [float("-inf")] + [0.0] * 39), (904, []), (905, [1.0] * 7)]
    rows += [(1000 + i, hot) for i in range(200)]
    df = spark.createDataFrame(rows + odd, VECTORS).repartition(7).withColumn("n", F.lit("x")).withColumn("Component", F.lit(3))
    got = whitening.whiten(df).collect()
    ids, deviations, want, explained = whitened_by_brute_force(rows + odd, 40)
    assert len(got) == 700 * 32 and {r["n"] for r in got} == {700} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8
    at, found = {i: k for k, i in enumerate(ids)}, np.full(want.shape, np.nan)
    for r in got:
        assert r["deviation"] == deviations[at[r["vec_id"]]] and math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        found[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    signs = np.sign((found * want).sum(axis=0))
    assert np.allclose(found * signs, want, atol=1e-8)
    assert np.abs(np.cov(found.T, bias=True) - np.eye(32)).max() < 1e-8


def test_whitening_without_variance_repeats_and_rows(spark):
    rows = [(4, [1.0, 2.0]), (5, [2.0, 2.0]), (None, [3.0, 2.0]), (5, [3.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"], r["deviation"]) for r in got) == sorted((str(i), k, 4, (4 * (64 * int(v[0])) - 64 * 9) ** 2) for i, v in rows for k in (1, 2))
    assert {(r["whitened"], r["explained"]) for r in got if r["component"] == 2} == {(0.0, 0.0)} and all(r["identity_error"] < 1e-9 for r in got)
    one = whitening.whiten(spark.createDataFrame(rows[:1], VECTORS)).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    for none in ([], [(1, None), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(none, VECTORS)).count() == 0


def test_whitening_refuses_what_no_long_holds(spark):
    for entries in ([1e30, 0.0], [6e14, -6e14]):
        with pytest.raises(Exception, match="beyond the range"):
            whitening.whiten(spark.createDataFrame([(1, entries), (2, [0.0, 0.0])] * 3, "vec_id long, embedding array<double>")).collect()
