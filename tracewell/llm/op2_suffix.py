"""Suffix-array dedup by prefix-free parsing.

A byte goes if a string of `length` bytes (100) covers it that also starts earlier: in a document of smaller id, or earlier in the same one. Strings never cross documents and are judged on the input.

1. Triggers. A rolling hash of WIDTH bytes triggers where it is the least of all hashes inside a string of `length` bytes, the leftmost of equal ones. So every such string has exactly one trigger, equal strings have theirs at the same place, and the strings of a document fall into runs with one trigger each: the phrases of the parse. A phrase with the bytes that its last string needs is what the parse names; strings are ordered by these alone, since no order beyond `length` bytes is asked for, so what the parse adds is part of the phrase.
2. Parse. Phrases meet by trigger, in buckets. Of a phrase that occurs again, all strings of the later occurrences are repeats: nothing more is done about them, however many. A trigger with one phrase only has no repeats but these.
3. Dictionary. What is left are the distinct phrases with a trigger that other phrases have as well: edges of repeated passages. Their texts are gathered, again by trigger, and the suffix array of each bucket's dictionary is built to a depth of `length`; of suffixes that are equal so far, all but the one that is first in the corpus are repeats.
4. The repeats of both steps go back to their documents, where their union is cut out.

Triggers shared by a great many different phrases (the edges of a passage that a third of all documents hold) would put all these in one bucket. A trigger with over LOCAL_PHRASES phrases within one slice (SLICE_BYTES of text), or over ALL_PHRASES in all, is hot; the strings of its phrases are dealt by fingerprints of their own (128 bits) instead.
Slices drop copies of a phrase before anything is shuffled. Nothing is gathered on the driver.

Nulls: a null text is empty. A null id comes after all others. Rows that share an id are told apart by a hash of their text and ordered by it; rows with the same id and text are one document, each judged alike. Texts shorter than `length` lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, in_pieces, mix, powers, prefix_hash, saved, span_hash

LENGTH, WIDTH = 100, 24
LOCAL_PHRASES, ALL_PHRASES = 64, 20_000
#: Bytes of text whose phrases are settled and dealt together.
SLICE_BYTES = 24 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max
#: What a shuffled row holds: records of one kind as parallel arrays.
ROWS = "bucket int, kind int, h1 array<long>, h2 array<long>, doc array<long>, pos array<long>, n array<int>, data binary"
TEXT, PHRASE, HOT, REPEAT, STRINGS, OPEN = 9, 1, 2, 3, 4, 5
EMPTY = {"h1": np.uint64, "h2": np.uint64, "doc": np.int64, "pos": np.int64, "n": np.int32}


def phrases(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """The phrases of each row: row, first and last string (byte offsets), hash of the trigger (h1) and of the phrase (h2)."""
    n, span = len(data), length - WIDTH + 1
    none = {k: np.zeros(0, t) for k, t in (("row", np.int64), ("a", np.int64), ("b", np.int64), ("h1", np.uint64), ("h2", np.uint64))}
    if n < length or not (np.diff(off) >= length).any():
        return none
    h = prefix_hash(data)
    _, down = powers(len(h))
    rolling = mix((h[WIDTH:] - h[:-WIDTH]) * down[: n - WIDTH + 1])
    bits = np.uint64(32)
    least = (rolling >> bits << bits) | np.arange(len(rolling), dtype=np.uint64)
    k = 1
    while 2 * k <= span:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if span > k:
        least = np.minimum(least[: len(least) - (span - k)], least[span - k :])
    trigger = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
    trigger, row = trigger[at], row[at]
    start = np.flatnonzero(np.append(True, (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])))
    a, b = at[start], at[np.append(start[1:], len(at)) - 1]
    return {"row": row[start], "a": a, "b": b, "h1": rolling[trigger[start]], "h2": span_hash(h, a, b + length)}


def batch(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (bucket, kind, arrays by name, data)."""
    cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())]
    for name, kind in EMPTY.items():
        parts = [r[2].get(name, np.zeros(0, kind)) for r in rows]
        flat_ = np.concatenate(parts).view(np.int64) if kind is np.uint64 else np.concatenate(parts)
        ends = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat_, pa.int32() if kind is np.int32 else pa.int64())))
    cols.append(pa.array([r[3] for r in rows], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, ["bucket", "kind", *EMPTY, "data"])


def unbatch(b: pa.RecordBatch) -> Iterator[tuple[int, int, dict[str, np.ndarray], bytes | None]]:
    lists = {}
    for k, (name, kind) in enumerate(EMPTY.items(), 2):
        c = b.column(k)
        v = c.flatten().to_numpy(zero_copy_only=False)
        lists[name] = (v.view(np.uint64) if kind is np.uint64 else v, np.append(0, np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))))
    data = b.column(len(EMPTY) + 2)
    for i, (bucket, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
        yield bucket, kind, {k: v[o[i] : o[i + 1]] for k, (v, o) in lists.items()}, data[i].as_py()


def dealt(kind: int, bucket: np.ndarray, **columns: np.ndarray) -> list[tuple]:
    """Rows with the records of each bucket; columns keep their order within it."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    parts = {k: np.split(v[order], cut[1:]) for k, v in columns.items()} if len(bucket) else {}
    return [(int(bucket[s]), kind, {k: parts[k][i] for k in parts}, None) for i, s in enumerate(cut)]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def together(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in EMPTY.items()}


def first_of(keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, then place in the corpus; which of these are the first of their key)."""
    order = np.lexsort((pos, doc, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, new


def parse_slices(n_buckets: int, length: int):
    """Documents to phrases in buckets by trigger; copies within a slice are settled here."""

    def settle(parts: list[dict[str, np.ndarray]]) -> list[tuple]:
        p = together(parts)
        order, new = first_of([p["h1"], p["h2"]], p["doc"], p["pos"])
        p = {k: v[order] for k, v in p.items()}
        same = lambda k: p[k] == np.roll(p[k], 1)
        again = ~new & ~(same("h1") & same("h2") & same("doc") & same("pos"))  # a repeated row is not its own repeat
        rows = dealt(REPEAT, bucket_of(p["doc"][again], n_buckets), **{k: p[k][again] for k in ("doc", "pos", "n")})
        p = {k: v[new] for k, v in p.items()}
        _, group, count = np.unique(p["h1"], return_inverse=True, return_counts=True)
        hot = count[group] > LOCAL_PHRASES
        marks = np.unique(p["h1"][hot])
        rows += dealt(HOT, bucket_of(p["doc"][hot], n_buckets), **{k: p[k][hot] for k in ("doc", "pos", "n")})
        rows += dealt(HOT + 100, bucket_of(marks, n_buckets), h1=marks)
        return rows + dealt(PHRASE, bucket_of(p["h1"][~hot], n_buckets), **{k: v[~hot] for k, v in p.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in in_pieces(batches, "t", 1 << 20):
            data, off = flat(b.column(1))
            p = phrases(data, off, length)
            if len(p["a"]):
                row = p["row"]
                held.append({"h1": p["h1"], "h2": p["h2"], "doc": doc_keys(b.column(0))[row], "pos": (ties(data, off)[row] << 32) | (p["a"] - off[row]), "n": (p["b"] - p["a"] + 1).astype(np.int32)})
            size += len(data)
            if size >= SLICE_BYTES and held:  # several pieces together, so that a row has many records of its bucket
                yield batch(settle(held))
                held, size = [], 0
        if held:
            yield batch(settle(held))

    return run


def doc_keys(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def ties(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """31 bits of a hash of each row's text."""
    return (span_hash(prefix_hash(data), off[:-1], off[1:]) >> np.uint64(33)).astype(np.int64) if len(data) else np.zeros(len(off) - 1, np.int64)


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each bucket, from a stream sorted by bucket."""
    now, rows = None, []
    for b in batches:
        for r in unbatch(b):
            if r[0] != now and rows:
                yield now, rows
                rows = []
            now = r[0]
            rows.append(r)
    if rows:
        yield now, rows


def settle_phrases(n_buckets: int):
    """Repeats among the phrases of each bucket, and the phrases that have to be looked into, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in buckets(batches):
            out = [r for r in rows if r[1] in (REPEAT, HOT)]
            marks = [r[2]["h1"] for r in rows if r[1] == HOT + 100]
            p = together([r[2] for r in rows if r[1] == PHRASE])
            if len(p["h1"]):
                order, new = first_of([p["h1"], p["h2"]], p["doc"], p["pos"])
                p = {k: v[order] for k, v in p.items()}
                again = ~new & ((p["doc"] != np.roll(p["doc"], 1)) | (p["pos"] != np.roll(p["pos"], 1)))
                out += dealt(REPEAT, bucket_of(p["doc"][again], n_buckets), **{k: p[k][again] for k in ("doc", "pos", "n")})
                p = {k: v[new] for k, v in p.items()}
                _, group, count = np.unique(p["h1"], return_inverse=True, return_counts=True)
                hot = (count[group] > ALL_PHRASES) | np.isin(p["h1"], np.concatenate(marks) if marks else [])
                some = ~hot & (count[group] > 1)
                out += dealt(HOT, bucket_of(p["doc"][hot], n_buckets), **{k: p[k][hot] for k in ("doc", "pos", "n")})
                out += dealt(OPEN, bucket_of(p["doc"][some], n_buckets), **{k: p[k][some] for k in ("h1", "doc", "pos", "n")})
            if out:
                yield batch(out)

    return run


def with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[int, dict], int, int, bytes]]:
    """(records of the bucket by kind, its document's key, tie and text) for each document, from a stream sorted by bucket with records before texts."""
    now, records, ready = None, {}, {}
    for b in batches:
        for bucket, kind, arrays, data in unbatch(b):
            if bucket != now:
                now, records, ready = bucket, {}, {}
            if kind != TEXT:
                records.setdefault(kind, []).append(arrays)
                continue
            if records:
                for k, parts in records.items():
                    one = together_some(parts)
                    order = np.lexsort((one["pos"], one["doc"]))
                    ready[k] = {c: v[order] for c, v in one.items()}
                records = {}
            yield ready, int(arrays["doc"][0]), int(arrays["pos"][0]), pa.decompress(data, int(arrays["n"][0]), "zstd", asbytes=True) if arrays["n"][0] else b""


def together_some(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in EMPTY if len(parts[0][k]) or k in ("doc", "pos", "n")}


def of_document(records: dict[str, np.ndarray] | None, doc: int, tie: int) -> tuple[int, int]:
    """Which of the sorted records are of a document."""
    if records is None:
        return 0, 0
    lo, hi = np.searchsorted(records["doc"], doc, "left"), np.searchsorted(records["doc"], doc, "right")
    return lo + int(np.searchsorted(records["pos"][lo:hi], tie << 32, "left")), lo + int(np.searchsorted(records["pos"][lo:hi], (tie + 1) << 32, "left"))


def gather(n_buckets: int, length: int):
    """Texts of the open phrases into dictionaries by trigger, and fingerprints of the strings of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, hot, size = [], [], 0

        def flush() -> list[tuple]:
            rows = []
            if open_:
                h1, doc, pos, n = (np.concatenate([o[k] for o in open_]) for k in range(4))
                texts = [t for o in open_ for t in o[4]]
                to = bucket_of(h1, n_buckets)
                order = np.argsort(to, kind="stable")
                for s in dealt(OPEN, to, doc=doc, pos=pos, n=n):
                    k, order = order[: len(s[2]["doc"])], order[len(s[2]["doc"]) :]
                    rows.append((s[0], OPEN, s[2], b"".join([texts[i] for i in k])))
            if hot:
                h1, h2, doc, pos = (np.concatenate([o[k] for o in hot]) for k in range(4))
                rows += dealt(STRINGS, bucket_of(h1, n_buckets), h1=h1, h2=h2, doc=doc, pos=pos, n=np.ones(len(doc), np.int32))
            open_.clear()
            hot.clear()
            return rows

        last = None
        for ready, doc, tie, text in with_texts(batches):
            if last == (doc, tie):
                continue  # a repeated row
            last = (doc, tie)
            a, b = of_document(ready.get(OPEN), doc, tie)
            if b > a:
                r = ready[OPEN]
                at = (r["pos"][a:b] & 0xFFFFFFFF).tolist()
                open_.append((r["h1"][a:b], r["doc"][a:b], r["pos"][a:b], r["n"][a:b], [text[s : s + m + length - 1] for s, m in zip(at, r["n"][a:b].tolist(), strict=True)]))
                size += sum(map(len, open_[-1][4]))
            a, b = of_document(ready.get(HOT), doc, tie)
            if b > a:
                r = ready[HOT]
                at = np.concatenate([np.arange(s, s + m) for s, m in zip((r["pos"][a:b] & 0xFFFFFFFF).tolist(), r["n"][a:b].tolist(), strict=True)])
                h = prefix_hash(np.frombuffer(text, np.uint8))
                hot.append((span_hash(h, at, at + length), span_hash(h, at, at + length // 2), np.full(len(at), doc), (tie << 32) | at))
                size += 32 * len(at)
            if size > 8 << 20:
                if rows := flush():
                    yield batch(rows)
                size = 0
        if rows := flush():
            yield batch(rows)

    return run


def suffix_array(texts: np.ndarray, starts: np.ndarray, doc: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes that begin at starts in order of their first `length` bytes, then of their place in the corpus; which differ there from the one before)."""
    windows = np.lib.stride_tricks.as_strided(texts, (len(texts) - length + 1, length), (1, 1))[starts]
    place = np.lexsort((pos, doc))
    text = np.ascontiguousarray(windows[place]).view(f"S{length}").ravel()
    order = np.argsort(text, kind="stable")
    text = text[order]
    return place[order], np.append(True, text[1:] != text[:-1])


def look_up(n_buckets: int, length: int):
    """Repeats by the suffix array of each bucket's dictionary, and by the fingerprints of hot strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in buckets(batches):
            out = []
            parts = [r for r in rows if r[1] == OPEN]
            if parts:
                p = together([{**r[2]} for r in parts])
                texts = np.frombuffer(b"".join([r[3] for r in parts]), np.uint8)
                begin = np.cumsum(p["n"] + np.int64(length - 1)) - (p["n"] + length - 1)
                k = np.arange(p["n"].sum()) - np.repeat(np.cumsum(p["n"]) - p["n"], p["n"])
                doc, pos = np.repeat(p["doc"], p["n"]), np.repeat(p["pos"], p["n"]) + k
                order, new = suffix_array(texts, np.repeat(begin, p["n"]) + k, doc, pos, length)
                out += intervals(doc[order[~new]], pos[order[~new]], n_buckets)
            s = together([r[2] for r in rows if r[1] == STRINGS])
            if len(s["h1"]):
                order, new = first_of([s["h1"], s["h2"]], s["doc"], s["pos"])
                out += intervals(s["doc"][order[~new]], s["pos"][order[~new]], n_buckets)
            if out:
                yield batch(out)

    return run


def intervals(doc: np.ndarray, pos: np.ndarray, n_buckets: int) -> list[tuple]:
    """Repeated strings as runs of consecutive starts, in rows by document."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    start = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(doc))).astype(np.int32)
    return dealt(REPEAT, bucket_of(doc[start], n_buckets), doc=doc[start], pos=pos[start], n=n)


def spans(at: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that the strings starting in at .. at+n-1 cover."""
    order = np.argsort(at, kind="stable")
    start, end = at[order], (at + n + length - 1)[order]
    end = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > end[:-1])
    cut = np.flatnonzero(new)
    return start[cut], end[np.append(cut[1:], len(end)) - 1]


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_removed, n_spans, kept_sha256; the kept columns and, if asked for, kept_text (bytes that a cut leaves incomplete are dropped)."""
    keep = [] if keep is None else keep
    key = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    total = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_buckets = max(48, -(-total // BUCKET_BYTES))
    parsed = src.mapInArrow(parse_slices(n_buckets, length), ROWS).repartition("bucket").sortWithinPartitions("bucket")
    first = saved(parsed.mapInArrow(settle_phrases(n_buckets), ROWS), "phrases", codec="zstd")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "t", 2 << 20):
            data, off = flat(b.column(1))
            doc, tie = doc_keys(b.column(0)), ties(data, off)
            raw = data.tobytes()
            size = np.diff(off)
            texts = [pa.compress(raw[s:e], "zstd", asbytes=True) if e > s else b"" for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            rows = batch([(int(k), TEXT, {"doc": doc[j : j + 1], "pos": tie[j : j + 1], "n": size[j : j + 1].astype(np.int32)}, t) for j, (k, t) in enumerate(zip(bucket_of(doc, n_buckets), texts, strict=True))])
            yield pa.RecordBatch.from_arrays([*rows.columns, b.column(2)], [*rows.schema.names, "row"])

    def texts(columns: list[str]) -> DataFrame:
        inner = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.struct(F.col(id_col).alias("_id"), *columns).alias("row"))
        return inner.mapInArrow(packed, f"{ROWS}, row {inner.schema['row'].dataType.simpleString()}")

    plain = texts([]).drop("row")
    seen = first.where(F.col("kind").isin(OPEN, HOT)).unionByName(plain).repartition("bucket").sortWithinPartitions("bucket", "kind", F.element_at("doc", 1), F.element_at("pos", 1))
    phrases_ = seen.mapInArrow(gather(n_buckets, length), ROWS).repartition("bucket").sortWithinPartitions("bucket")
    second = saved(phrases_.mapInArrow(look_up(n_buckets, length), ROWS), "strings")

    rowed = texts(keep)
    row_kind = rowed.schema["row"].dataType.simpleString()
    repeats = first.where(f"kind = {REPEAT}").unionByName(second).withColumn("row", F.lit(None).cast(row_kind))
    final = repeats.unionByName(rowed).repartition("bucket").sortWithinPartitions("bucket", "kind")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tapped(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in source:
                held.append(b.column(b.num_columns - 1).filter(pa.compute.equal(b.column(1), TEXT)))
                yield b

        held: list[pa.Array] = []
        out: list[tuple] = []

        def ready_batch() -> pa.RecordBatch:
            row = pa.concat_arrays(held)
            cols = [row.slice(0, len(out)), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))]
            held[:] = [row.slice(len(out))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

        size = 0
        for ready, doc, tie, text in with_texts(tapped(batches)):
            r = ready.get(REPEAT)
            a, b = of_document(r, doc, tie)
            pieces, gone, at, n = [], 0, 0, 0
            if b > a:
                start, end = spans(r["pos"][a:b] & 0xFFFFFFFF, r["n"][a:b].astype(np.int64), length)
                n = len(start)
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    pieces.append(text[at:s])
                    at, gone = e, gone + e - s
            pieces.append(text[at:])
            left = b"".join(pieces)
            # a cut may leave parts of a character on either side: each piece is decoded on its own
            shown = "".join([p.decode("utf-8", "ignore") for p in pieces]) if with_text else None
            out.append((len(text), gone, n, hashlib.sha256(left).hexdigest(), shown))
            size += len(left)
            if len(out) >= 2000 or size > 8 << 20:
                yield ready_batch()
                size = 0
        if out:
            yield ready_batch()

    got = final.mapInArrow(cut, f"row {row_kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return got.select(F.col("row._id").alias(id_col), *[F.col(f"row.`{c}`") for c in keep], "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else []))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
