"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, with calibrated rejection.

A text, with a space before and after, is the mean of the embeddings of its byte 3- and 4-grams (A-Z lower-cased, each white-space byte as a space), each hashed to a row of the table. A softmax over a linear map of that mean gives the languages.
A temperature fitted on labelled rows that were not trained on calibrates its probabilities; a text whose calibrated probability stays below a threshold, or that has no letter, is rejected.
As the map is linear, a prediction needs only the product of table and map: one row of logits for each bucket, which tasks carry as a broadcast of fixed size.

Training reads a bounded sample of all labelled rows: of each language the same number of rows, `sample` (3,000 by default) in all, those with the lowest hashes of id and text, so that no language is lost where ids are null or repeat; rows that repeat both are learned from once. Executors turn their whole texts into counts of buckets, at most BUCKETS for a text of any length; the driver takes rows in order of the hash until it has ENTRIES counts, at least one row of each language. A quarter of the rows is for calibration. Predictions read whole texts.

Nulls: a null or empty text, or one without letters, is 'und' with score 0. Rows without a label are never learned from. Without any labelled row everything is 'und'. Repeated rows are predicted alike. Extra columns are ignored; kept ones may have any name but lang_pred, score and rejected. An empty table has no predictions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat, in_pieces, lower_ascii, saved

BUCKETS, DIM, SAMPLE = 1 << 16, 16, 3000
#: Counts of buckets (8 bytes each) that training takes to the driver, beside one row of each language.
ENTRIES = 8_000_000
#: A prediction is rejected below this calibrated probability.
REJECT = 0.4
LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the grams in each row, and the n+1 offsets of rows in them; grams do not cross rows."""
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    d = np.full(len(data) + 2 * (len(off) - 1), 32, np.uint8)  # a space before and after each row
    d[np.arange(len(data)) + 2 * row_of + 1] = lower_ascii(data)
    off = off + 2 * np.arange(len(off))
    d[(d >= 9) & (d <= 13)] = 32
    n = len(d)
    v = d.astype(np.uint32)
    end = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # bytes from here to the row's end
    out, row = [], []
    at = np.arange(n)
    for k, salt in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        if n < k:
            continue
        g = v[: n - k + 1].copy()
        for j in range(1, k):
            g = (g << np.uint32(8)) | v[j : n - k + 1 + j]
        ok = end[: n - k + 1] >= k
        h = (g * np.uint32(salt)) ^ (g >> np.uint32(15))
        h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        out.append(h[ok].astype(np.int64))
        row.append(at[: n - k + 1][ok])
    if not out:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    counts = [np.searchsorted(r, off) for r in row]
    if len(out) == 1:
        return out[0], counts[0]
    total = counts[0] + counts[1]
    place3 = np.arange(len(out[0])) + np.repeat(counts[1][:-1], np.diff(counts[0]))
    place4 = np.arange(len(out[1])) + np.repeat(counts[0][1:], np.diff(counts[1]))
    both = np.empty(total[-1], np.int64)
    both[place3], both[place4] = out[0], out[1]
    return both, total


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's grams and how often each occurs."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.unique(grams(raw, np.array([0, len(raw)]))[0], return_counts=True)


def train(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], steps: int = 12_000, rate: float = 0.5, seed: int = 7) -> dict:
    """The model from the bucket counts of labelled texts: its languages, one row of logits for each bucket, and the temperature."""
    langs = sorted(set(labels))
    if not langs:
        return {"langs": [], "logits": np.zeros((BUCKETS, 0), np.float32), "temperature": 1.0}
    rng = np.random.default_rng(seed)
    table = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    weight = np.zeros((DIM, len(langs)), np.float32)
    y = np.array([langs.index(x) for x in labels])
    docs = [c if len(c[0]) else None for c in counts]
    held = np.arange(len(docs)) % 4 == 3
    usable = np.array([d is not None for d in docs])
    learn = np.flatnonzero(usable & ~held) if (usable & ~held).any() else np.flatnonzero(usable)
    epochs = max(4, -(-steps // max(1, len(learn))))  # few rows are gone through more often
    total, step = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            b, c = docs[i]
            share = (c / c.sum()).astype(np.float32)
            x = share @ table[b]
            g = softmax(x @ weight)
            g[y[i]] -= 1
            lr = np.float32(rate * (1 - step / total))
            back = weight @ g
            weight -= lr * np.outer(x, g)
            table[b] -= lr * 20 * share[:, None] * back  # shares are small: rows move by a multiple of them
            step += 1
    logits = table @ weight
    check = np.flatnonzero(usable & held) if (usable & held).any() else learn
    z = np.array([(docs[i][1] / docs[i][1].sum()) @ logits[docs[i][0]] for i in check]).reshape(-1, len(langs))
    grid = np.geomspace(0.002, 20, 120)
    doubt = 1 / (len(check) + 2)  # a rule of succession: no sample, however well predicted, makes certain
    logs = [np.log(softmax(z / t) + 1e-12) for t in grid]
    loss = [-((1 - doubt) * p[np.arange(len(check)), y[check]] + doubt * p.mean(1)).mean() for p in logs] if len(check) else [0.0]
    return {"langs": langs, "logits": logits, "temperature": float(grid[int(np.argmin(loss))])}


def predict(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Of each text the likeliest language ('und' without letters) and its calibrated probability."""
    data, off = flat(column)
    n = len(off) - 1
    if not model["langs"]:
        return ["und"] * n, np.zeros(n)
    bucket, at = grams(data, off)
    sums = np.zeros((n, len(model["langs"])))
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for k in range(sums.shape[1]):
            sums[some, k] = np.add.reduceat(model["logits"][:, k][bucket], at[some])
    p = softmax(sums / np.maximum(np.diff(at), 1)[:, None] / model["temperature"])
    best = p.argmax(1)
    lettered = [bool(LETTER.search(t)) if t else False for t in column.to_pylist()]
    names = [model["langs"][b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
    return names, np.where(lettered, p.max(1), 0.0)


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, entries: int = ENTRIES) -> dict:
    """Trains on the driver from the bucket counts of at most `sample` labelled rows (one of each language where there are more), the same number of each language as far as it has them, and of these in order of their hashes as many as hold `entries` counts."""
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(1)).alias("o"), F.col(text_col).alias("t"), F.col(label_col).alias("l"))
    low = F.pmod(F.col("o"), F.lit(1 << 40))
    sizes = saved(rows.groupBy("l").agg(F.approx_count_distinct("o").alias("n"), F.min(low).alias("least")), "labels")
    quota = max(1, sample // max(1, sizes.count()))
    # a cut of the hash that leaves about twice the quota of each language, and its lowest in any case, so that no task ranks more
    share = F.least(F.lit(1.0), F.lit(2.0 * quota + 64) / F.col("n"))
    near = rows.select("o", "l", "t").join(sizes, "l").where((low < share * (1 << 40)) | (low == F.col("least")))
    place = F.row_number().over(Window.partitionBy("l").orderBy("o"))
    picked = saved(near.select("o", "l").distinct().withColumn("place", place).where(F.col("place") <= quota), "picked")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # of the sample's rows: those that repeat are counted once a task, and once in all below
        for b in in_pieces(batches, "t", 1 << 20):
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            first = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            b = b.take(pa.array(first, pa.int64()))
            pairs = [counted(t) for t in b.column(3).to_pylist()]
            size = pa.array([len(p[0]) for p in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), size, *(pa.array([p[k].astype("<i4").tobytes() for p in pairs], pa.binary()) for k in (0, 1))], ["o", "l", "place", "size", "buckets", "times"])

    kind = docs.schema[label_col].dataType.simpleString()
    chosen = near.select("o", "l", "t").join(picked, ["o", "l"]).select("o", "l", "place", "t")
    table = saved(chosen.mapInArrow(count, f"o long, l {kind}, place int, size long, buckets binary, times binary").dropDuplicates(["o", "l"]), "sample")
    before = F.coalesce(F.sum("size").over(Window.orderBy("place", "o", "l").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = table.select("o", "l", "place", "size").distinct().withColumn("before", before).where((F.col("place") == 1) | (F.col("before") < entries))  # a row of the sample each
    got = table.join(F.broadcast(taken.select("l", "place")), ["l", "place"], "left_semi").orderBy("place", F.xxhash64("o", "l")).collect()  # languages by turns, so that each has its part of the rows for calibration
    return train([(np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["times"], "<i4")) for r in got], [r["l"] for r in got])


def identify(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of each row with lang_pred, score and rejected."""
    keep = docs.columns if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "t", 1 << 18):
            names, score = predict(held.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    kind = inner.schema["row"].dataType.simpleString()
    out = inner.mapInArrow(run, f"row {kind}, lang_pred string, score double")
    return out.select("row.*", "lang_pred", "score", ((F.col("lang_pred") == "und") | (F.col("score") < REJECT)).alias("rejected"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
