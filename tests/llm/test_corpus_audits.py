"""Spelling variants, divergences of sources and archives against plain versions, and on odd tables."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from test_ops import ODD, none, odd, odd_rows  # noqa: F401

from pyspark.sql import functions as F
from tracewell.llm import op11_variants, op12_divergence, op13_warc


def plain_variants(counts, ratio=2):
    """(word: form, root, n, n_near, form_n) by comparing all pairs."""

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, rows = {}, {}
    for w, n in counts.items():
        others = sorted((x for x in counts if near(w, x)), key=lambda x: (-counts[x], x.encode()))
        if others and counts[others[0]] >= ratio * n:
            form[w] = others[0]
        rows[w] = len(others)
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, rows[w], counts[form[w]] if w in form else None)
    return out


def variants_of(spark, counts, **more):
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, key int")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op11_variants.variants(df, **more).collect()}


def test_op11_brute_force(spark):
    r = random.Random(4)
    counts = {}
    while len(counts) < 400:
        w = "".join(r.choice("abé") for _ in range(r.randrange(5, 8)))
        counts[w] = r.choice((3, 3, 4, 6, 9, 18, 40))
    counts |= {"aaaaaaaa": 50, "aaaaaaa": 3, "aaaaabaa": 7, "baaaaaaa": 7, "ýouseful": 3, "youseful": 6, "yousefull": 20, "yousefül": 6}
    assert variants_of(spark, counts) == plain_variants(counts)


def test_op11_hot_position(spark):
    """Many words that differ at one place are near each other, and no pair of them is listed."""
    letters = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xE0, 0x100)]
    counts = {f"pre{c}post": 3 + k for k, c in enumerate(letters)} | {"prepost": 400}
    assert variants_of(spark, counts) == plain_variants(counts)


def test_op11_chain(spark):
    counts = {"a" * k + "bcdef": 3 * 2**k for k in range(20)}
    got = variants_of(spark, counts)
    assert got == plain_variants(counts) and {v[1] for v in got.values()} == {"a" * 19 + "bcdef"}


def test_op11_occurrences(spark, odd, none):  # noqa: F811
    got = {r.word: r.n for r in op11_variants.occurrences(odd, misspell=3).collect()}
    want = Counter()
    for i, t, *_ in odd_rows():
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w] += 1
    assert got == want
    assert op11_variants.variants(op11_variants.occurrences(none)).count() == 0
    assert op11_variants.variants(op11_variants.occurrences(odd), least_count=10**9).count() == 0


def plain_divergences(rows, least, top):
    docs = [("" if lang is None else lang, "" if s is None else s, [m.translate(LOW) for m in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode())]) for t, lang, s in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(w for d in docs if d[0] == lang for w in set(d[2]))
        kept = [w for w in df if df[w] >= least]
        groups = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, words in docs:
            if x == lang:
                groups[s].update(w for w in words if df[w] >= least)
        everything = sum(groups.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(everything)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(o.encode(), sum(f(p[s][w], p[o][w]) for w in kept)) for o in groups if o != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if groups[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for k, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0]))[:most]):
                    out.add((lang, s, part, item.decode(), v, k + 1))
    return out


LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TEXTS = "text string, lang string, source string, n int, block int, term string"


@pytest.mark.parametrize("cells, piece", [(1 << 15, 8 << 20), (8, 300)])
def test_op12_brute_force(spark, monkeypatch, cells, piece):
    """Blocks of few cells and pieces shorter than texts give the same."""
    monkeypatch.setattr(op12_divergence, "CELLS", cells)
    monkeypatch.setattr(op12_divergence, "PIECE", piece)
    r = random.Random(6)
    words = [f"w{chr(97 + k)}" for k in range(26)] + ["Ünï", "ΩΩ", "日本", "😀", "x" * 400]
    rows = [(" ".join(r.choice(words[: 5 + 2 * s]) for _ in range(r.choice((0, 3, 40, 400)))), r.choice(["en", "de", None, ""]), f"s{s}") for s in r.choices(range(12), k=120)]
    rows += [(None, "en", None), ("", "only", "one"), ("", "two", "a"), ("few words", "two", "b"), rows[0], rows[0]]
    df = spark.createDataFrame([x + (1, 2, "t") for x in rows], TEXTS).repartition(3)
    got = [tuple(x) for x in op12_divergence.divergences(df, least_docs=4, top=3).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergences(rows, 4, 3)


def test_op12_same_hash():
    """Slices of one hash are told apart by their bytes."""
    np = op12_divergence.np
    data = np.frombuffer(b"ab abc ab xyz abd abc", np.uint8)
    start, end = op12_divergence.slices(data, np.array([0, 9, 21]))
    number, terms = op12_divergence.term_ids(data, start, end, hashed=lambda b: 7)
    assert [terms[k] for k in number] == [b"ab", b"abc", b"ab", b"xyz", b"abd", b"abc"] and len(set(terms)) == len(terms) == 4


def test_op12_large_counts():
    np = op12_divergence.np
    for n, whole in ((0, 2), (80_000_000_000_000, 90_000_000_000_001), (10**13, 10**13 + 2)):
        assert op12_divergence.shares(np.array([n]), np.array([whole]))[0] == 1 + 10**9 * (n + 2) // whole
    with pytest.raises(OverflowError):
        op12_divergence.shares(np.array([10**15]), np.array([10**15]))


def test_op12_empty(spark):
    assert op12_divergence.divergences(spark.createDataFrame([], TEXTS)).count() == 0


PAGES = "page_id long, url string, html string, file string, row int, kind string, start long"


def page_rows():
    long, other = "<p>" + "é" * 70 + "</p>", "y" * 100
    rows = [(5, "http://a.b/x?q=1#f", long), (3, "http://A.b/ y", long), (9, None, long), (None, "http://c.d/", long), (4, "no scheme", "short"), (7, "http://a.b/", "short"), (8, "u", None), (6, "u", ""), (1, "u", "x" * 99), (2, "u", "x" * 99), (11, "u", other), (11, "u", other), (11, "v", other), (None, None, None), (12, "http://e.f/\r\nx: y", "z" * 3_000_000)]
    return [x + ("f", 0, "k", 1) for x in rows]


def digest_rows(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.kind, str(r.refers)) for r in df.collect())


def told(rows):
    return rows.select(op13_warc.field("metadata", "page-id").alias("page_id"), F.length("payload").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "kind", op13_warc.field("original.metadata", "page-id").alias("refers"))


@pytest.mark.parametrize("filtered, file_bytes, sent", [(False, 256 << 20, 16 << 20), (True, 1, 0)])
def test_op13_round_trip(spark, tmp_path, monkeypatch, filtered, file_bytes, sent):
    monkeypatch.setattr(op13_warc, "FILE", file_bytes)
    monkeypatch.setattr(op13_warc, "SENT", sent)
    pages = spark.createDataFrame(page_rows(), PAGES)
    if filtered:
        pages.write.parquet(str(tmp_path / "pages"))
        pages = spark.read.parquet(str(tmp_path / "pages")).where("coalesce(page_id, 0) <> 1000")
    else:
        pages = pages.repartition(2)
    want, seen = [], {}
    for i, _, h, *_ in sorted(page_rows(), key=lambda x: (x[0] is None, x[0] or 0)):
        b = (h or "").encode()
        first = seen.setdefault(b, i) if len(b) >= 100 else None
        again = len(b) >= 100 and b in [x for x, _ in want]
        want.append((b, (str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(first) if again else "None")))
    files = op13_warc.write_archives(pages)
    records = op13_warc.read_records(files)
    rows = op13_warc.with_payloads(op13_warc.captures(records))
    assert digest_rows(told(rows)) == sorted(w for _, w in want)
    all_ = records.collect()
    assert Counter(r.kind for r in all_ if r.kind != "warcinfo") == {"request": 15, "metadata": 15, "response": 10, "revisit": 5}
    assert all(r.intact for r in all_ if r.kind == "response") and all(r.payload_bytes is None for r in all_ if r.kind == "revisit")
    assert sum(r.n_records for r in files.collect()) == len(all_)
    by = {r.response.payload_digest + str(r.target): r for r in rows.collect()}
    assert all(r.request.block.startswith("GET /") for r in by.values())
    # a reader of gzip alone reads the files
    names = {r.file for r in files.collect()}
    text = b"".join(gzip.open(n.removeprefix("file://")).read() for n in names)
    assert text.count(b"WARC/1.1\r\n") == len(all_) and b"WARC-Target-URI: http://e.f/%0D%0Ax:%20y\r\n" in text


def test_op13_other_archives(spark, tmp_path):
    """Plain files, records in any order, identifiers that point the other way or over another record, lost responses, a damaged payload, repeated records."""

    def record(kind, i, body, *headers):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\n".encode() + "".join(f"{h}\r\n" for h in headers).encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    warc = record("warcinfo", "i", b"") + record("metadata", "m2", b"a: b\r\n c\r\n", "WARC-Concurrent-To: <q1>", "Content-Type: application/warc-fields") + record("request", "q1", b"GET / HTTP/1.1\r\n\r\n")
    warc += record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\nbody", http, "WARC-Concurrent-To: <q1>", "WARC-Payload-Digest: sha256:" + "0" * 64) + record("metadata", "m9", b"", "WARC-Concurrent-To: <lost>")
    (tmp_path / "a.warc").write_bytes(warc)
    (tmp_path / "b.warc").write_bytes(record("revisit", "v1", b"HTTP/1.1 200 OK\r\n\r\n", http, "WARC-Refers-To: <r1>") + record("revisit", "v2", b"", "WARC-Refers-To: <nowhere>") + record("resource", "s1", b"raw \xff", "Content-Type: x/y") + record("request", "q1", b"GET / HTTP/1.1\r\n\r\n"))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record("metadata", "m1", b"x", "WARC-Concurrent-To: <r1>")))
    records = op13_warc.read_records(op13_warc.archive_files(spark, str(tmp_path)))
    got = {r.capture_id: r for r in op13_warc.with_payloads(op13_warc.captures(records)).collect()}
    assert set(got) == {"r1", "v1", "v2", "s1", "m9"}
    assert got["r1"].request.record_id == "q1" and [m.record_id for m in got["r1"].metadata] == ["m1", "m2"] and got["r1"].response.intact is False
    assert got["r1"].metadata[1].fields == {"a": "b c"}
    assert [bytes(got[k].payload) for k in ("r1", "v1", "s1")] == [b"body", b"body", b"raw \xff"] and got["v2"].payload is None and got["m9"].kind is None
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(record("request", "a", b"") * 2))
    with pytest.raises(Exception, match="more than one record"):
        op13_warc.read_records(op13_warc.archive_files(spark, str(tmp_path))).collect()


def test_op13_empty(spark):
    none_ = spark.createDataFrame([], PAGES)
    assert op13_warc.with_payloads(op13_warc.captures(op13_warc.read_records(op13_warc.write_archives(none_)))).count() == 0


def test_op12_no_char_is_cut():
    np = op12_divergence.np
    raw = "naïve 日本語, Ω".encode()
    start, end = op12_divergence.slices(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[s:e].decode() for s, e in zip(start, end, strict=True)] == ["naïve", "日本語", "Ω"]
    assert pa.array([raw[s:e] for s, e in zip(start, end, strict=True)]).cast(pa.string()).to_pylist() == ["naïve", "日本語", "Ω"]
