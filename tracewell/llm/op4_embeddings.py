"""Embedding near-dedup with an inverted multi-index.

1. Vectors are brought to length 1 in double precision, by their largest component first, so that no square overflows. Equal ones of a label are one class with a count, so copies are never paired.
2. For each length of vectors that the table holds, two codebooks, one for each half of the vectors, are trained by k-means on a bounded sample (`sample` classes, the lowest by a hash of the vector, or CODE_ROWS for each codeword where that is more; all lengths share `sample`). Codewords grow with the square root of the vectors, so that a cell of their product, the grid, keeps about CELL of them. Every vector is indexed in the cell of its nearest codewords.
3. A query visits cells in the order of the multi-sequence algorithm: over the two lists of codewords, sorted by falling chance of holding a neighbour, a frontier of cells is kept, the likeliest of which is visited next and opens its successors, until the visited cells hold a neighbour at the threshold with probability `recall`. The product of the lists is never built; the frontiers of a batch of queries move together.
   A neighbour at cosine c is a step of length sqrt(2 - 2c) away, taken as a normal deviate along the normal of each boundary between codewords, so the chance to have crossed it follows from the distance to it. How wide the deviate is across each boundary comes from the data (`step_factors`): the sample's covariance and its own neighbours, and never less than for a step in a random direction.
   A pair is found if either side visits the other's cell; the target holds for each side alone, so it needs no independence of the two. Each pair is counted once on both sides.
4. Neighbouring cells of a label are regions of about BLOCK vectors. A query goes once to each region in which it visits cells, with the list of these, so vectors are not copied to cells. A region with more is dealt in blocks of BLOCK vectors, its visitors likewise; a task compares each visitor with the vectors in the cells that it visits, by a matrix product in double precision. It returns counts and a spanning forest of the links, never the pairs.
5. Components come from the spanning forests.

Nulls: a null label, a null or empty vector, a vector of zeros, or one with null or non-finite components links with nothing and is kept. Vectors of different lengths do not link. A null id links with nothing. Rows that repeat an id with the same vector count as one vector, with another vector each on its own; n_links is then the sum of an id's rows. Very long vectors only cost more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, grouped, roots, runs, saved

SAMPLE, BLOCK, ITERATIONS, RECALL, NEIGHBOURS = 20_000, 2048, 8, 0.99, 4000
#: Vectors in a cell, rows of the sample for each codeword, boundaries that bound a codeword's region.
CELL, CODE_ROWS, NEAREST = 50, 4, 16


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix of doubles) for each length of the vectors in a list column."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        yield rows, values[start[rows][:, None] + np.arange(dim)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; no row is zero or has a component that is not finite."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(rows: list[bytes], kind: str) -> np.ndarray:
    """Rows of one length as unit vectors."""
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)
    return unit(x.astype(np.float64))


def k_means(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """At most k distinct codewords."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    code = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(ITERATIONS):
        near = np.concatenate([((code**2).sum(1) - 2 * x[lo : lo + 1024] @ code.T).argmin(1) for lo in range(0, len(x), 1024)])
        total = np.zeros_like(code)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        code = np.where(n > 0, total / np.maximum(n, 1), code)
    return code


def codes_for(n: int) -> int:
    """Codewords of a half for n vectors: about CELL vectors in a cell of the grid."""
    return max(1, math.ceil(math.sqrt(n / CELL)))


def distances(x: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Squared; the same for a row whatever rows stand beside it, as a matrix product is not."""
    return ((x[:, None, :] - code[None]) ** 2).sum(-1)


def step_factors(x: np.ndarray, cosine: float) -> list[np.ndarray]:
    """Square roots of the covariances that a neighbour's step may have: a step in any direction alike, one that follows the spread of the sample, and one that follows the sample's own neighbours."""
    dim, square = x.shape[1], max(1e-12, 2 - 2 * cosine)
    kinds = [np.eye(dim) * (square / dim)]
    own = np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.zeros((dim, dim))
    if np.trace(own) > 0:
        kinds.append(own * (square / np.trace(own)))
    steps, some = [], x[:NEIGHBOURS]
    for lo in range(0, len(some), 256):
        c = some[lo : lo + 256] @ x.T
        c[(c < cosine) | (c > 1 - 1e-9)] = 2
        v = c.argmin(1)  # one neighbour for each, the farthest, so that no large group outweighs the rest
        q = np.flatnonzero(c[np.arange(len(c)), v] < 2)
        far = x[v[q]] - some[lo + q]
        steps.append(far / np.sqrt((far**2).sum(1))[:, None])
    steps = np.concatenate(steps) if steps else np.zeros((0, dim))
    if len(steps) >= dim:
        kinds.append(steps.T @ steps * (square / len(steps)))
    return kinds


def arranged(code: np.ndarray) -> np.ndarray:
    """The place of each codeword in an order that keeps near ones together: halves along the widest direction, again and again."""

    def halves(at: np.ndarray) -> list[int]:
        if len(at) < 2:
            return at.tolist()
        x = code[at] - code[at].mean(0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1] if x.shape[1] else np.zeros(len(at))
        order = at[np.argsort(along, kind="stable")]
        return halves(order[: len(at) // 2]) + halves(order[len(at) // 2 :])

    place = np.empty(len(code), np.int64)
    place[halves(np.arange(len(code)))] = np.arange(len(code))
    return place


class Grid:
    """Two codebooks and what the traversal needs to know of their boundaries."""

    def __init__(self, x: np.ndarray, n: int, cosine: float) -> None:
        self.half = x.shape[1] // 2
        self.codes = [k_means(x[:, : self.half], codes_for(n)), k_means(x[:, self.half :], codes_for(n))]
        self.places = [arranged(c) for c in self.codes]
        self.steps: list[list[np.ndarray]] = [[], []]
        for kind in step_factors(x, cosine) if max(map(len, self.codes)) > 1 else []:
            for h, at in enumerate((slice(0, self.half), slice(self.half, x.shape[1]))):
                w, v = np.linalg.eigh(kind[at, at])
                self.steps[h].append(self.codes[h] @ (v * np.sqrt(np.maximum(w, 0))))

    @classmethod
    def of(cls, state: dict) -> Grid:
        """A grid from its attributes: a broadcast holds these alone, as executors do not know the class."""
        grid = cls.__new__(cls)
        grid.__dict__.update(state)
        return grid

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def parts(self, x: np.ndarray) -> Iterator[slice]:
        most = max(1, 2_000_000 // (max(map(len, self.codes)) * max(1, x.shape[1] - self.half)))
        return (slice(lo, lo + most) for lo in range(0, len(x), most))

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out = [np.zeros(0, np.int64)]
        for at in self.parts(x):
            a, b = (distances(y, c).argmin(1) for y, c in zip(self.halves(x[at]), self.codes, strict=True))
            out.append(a * len(self.codes[1]) + b)
        return np.concatenate(out)

    def chances(self, x: np.ndarray, h: int) -> np.ndarray:
        """For each row of a half and each codeword the chance that a neighbour's nearest codeword is that one."""
        code = self.codes[h]
        if len(code) == 1:
            return np.ones((len(x), 1))
        d, row = distances(x, code), np.arange(len(x))
        near = np.argsort(d, axis=1, kind="stable")[:, :NEAREST]
        which, at = np.unique(near, return_inverse=True)
        at = at.reshape(near.shape)
        wide = np.sqrt(np.maximum(np.max([distances(y[which], y) for y in self.steps[h]], axis=0), 1e-30))
        # the signed distance to the region of a codeword, in deviations: the farthest of the half-spaces that bound it
        gap = np.full(d.shape, -np.inf)
        for k in range(near.shape[1]):
            one = (d - d[row, near[:, k]][:, None]) / (2 * wide[at[:, k]])
            one[row, near[:, k]] = -np.inf
            gap = np.maximum(gap, one)
        p = 1 / (1 + np.exp(np.clip(1.702 * gap, -60, 60)))  # the normal distribution, as near as a logistic one comes
        return p / p.sum(1, keepdims=True)

    def visits(self, x: np.ndarray, recall: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells) of all visits, in order of the rows."""
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in self.parts(x):
            a, b = self.halves(x[at])
            r, c = multi_sequence(self.chances(a, 0), self.chances(b, 1), recall)
            rows.append(r + at.start)
            cells.append(c)
        return np.concatenate(rows), np.concatenate(cells)

    def regions(self, cell: np.ndarray, side: np.ndarray) -> np.ndarray:
        """The region of each cell where a label has side * side of them."""
        u, v = cell // len(self.codes[1]), cell % len(self.codes[1])
        return (self.places[0][u] * side // len(self.codes[0])) * side + self.places[1][v] * side // len(self.codes[1])


def multi_sequence(p: np.ndarray, q: np.ndarray, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cells), by rows: for each row the cells (i, j) by falling p[i] * q[j], until these products come to recall.

    The frontier holds for each opened codeword of the first list the place that it has come to in the second; the first visit of the last opened one opens the next.
    """
    n, width = len(p), q.shape[1]
    first, second = np.argsort(-p, axis=1, kind="stable"), np.argsort(-q, axis=1, kind="stable")
    p, q = np.take_along_axis(p, first, 1), np.take_along_axis(q, second, 1)
    row, total, opened = np.arange(n), np.zeros(n), np.zeros(n, np.int64)
    place, value = np.zeros((n, 8), np.int64), np.full((n, 8), -1.0)
    value[:, 0] = p[:, 0] * q[:, 0]
    rows, cells = [], []
    while len(row):
        k = np.arange(len(row))
        i = value.argmax(1)
        j, best = place[k, i], value[k, i]
        rows.append(row)
        cells.append(first[row, i] * width + second[row, j])
        total += best
        j = j + 1
        place[k, i] = j
        value[k, i] = np.where(j < width, p[row, i] * q[row, np.minimum(j, width - 1)], -1.0)
        more = np.flatnonzero((i == opened) & (j == 1) & (i + 1 < p.shape[1]))
        if len(more):
            opened[more] += 1
            if opened[more].max() >= value.shape[1]:
                place = np.pad(place, ((0, 0), (0, place.shape[1])))
                value = np.pad(value, ((0, 0), (0, value.shape[1])), constant_values=-1.0)
            value[more, opened[more]] = p[row[more], opened[more]] * q[row[more], 0]
        on = (total < recall) & (value.max(1) >= 0)
        if not on.all():
            row, total, opened, place, value = row[on], total[on], opened[on], place[on], value[on]
    rows, cells = np.concatenate(rows), np.concatenate(cells)
    order = np.argsort(rows, kind="stable")
    return rows[order], cells[order]


def linked_vectors(table: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row of the table."""
    kind = table.schema[id_col].dataType.simpleString()
    raw = "<f4" if isinstance(table.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    rows = table.select(F.col(id_col).alias("i"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<float>" if raw == "<f4" else "array<double>").alias("v"))
    usable = rows.where("i IS NOT NULL AND label IS NOT NULL AND size(v) > 0").select(F.col("i").cast("long").alias("i"), F.xxhash64(F.col("label").cast("string")).alias("label"), "v")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors without null, non-finite or only zero components, with a digest of the unit vector."""
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                for at, x in by_length(part.column(2)):
                    good = np.isfinite(x).all(1) & (x != 0).any(1)
                    at, x = pa.array(at[good]), x[good]
                    keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in unit(x) + 0.0]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in x.astype(raw)], pa.binary())], ["i", "label", "dim", "key", "v"])

    members = saved(usable.mapInArrow(prepare, "i long, label long, dim int, key binary, v binary"), "vectors")
    vector = ["label", "dim", "key"]
    classes = members.groupBy(*vector).agg(F.min("i").alias("c"), F.count_distinct("i").alias("n"), F.first("v").alias("v"))
    # an id with several vectors: classes that share it need names of their own, and are one component
    own = members.select("i", *vector).distinct()
    several = bool(own.groupBy("i").count().where("count > 1").limit(1).count())
    if several:
        again = F.row_number().over(Window.partitionBy("c").orderBy(*vector)) > 1
        classes = classes.withColumn("low", F.col("c")).withColumn("c", F.when(again, F.xxhash64("c", *vector)).otherwise(F.col("c")))
    classes = saved(classes, "classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    grids: dict[int, dict] = {}
    if sizes:
        wanted = {d: max(sample // len(sizes), CODE_ROWS * codes_for(n)) if n > CELL else 1 for d, n in sizes.items()}
        plan = table.sparkSession.createDataFrame([(d, wanted[d], min(1.0, 2 * (wanted[d] + 32) / n)) for d, n in sizes.items()], "dim int, wanted int, share double")
        # the lowest hashes: first by a cut that leaves about twice as many, so that no task ranks more
        near = classes.withColumn("o", F.xxhash64("key")).join(F.broadcast(plan), "dim").where(F.pmod(F.col("o"), F.lit(1 << 40)) < F.col("share") * (1 << 40))
        taken = near.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("o", "key", "label"))).where("place <= wanted").select("dim", "v").toPandas()
        grids = {int(d): vars(Grid(matrix(list(p["v"]), raw), sizes[d], cosine)) for d, p in taken.groupby("dim")}
    held = table.sparkSession.sparkContext.broadcast(grids)  # grows with the square root of the vectors

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for the region of its cell, and once for each region in which it visits cells."""
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                dims = part.column(2).to_numpy()
                for dim in np.unique(dims):
                    one = part.take(pa.array(np.flatnonzero(dims == dim)))
                    grid, side = Grid.of(held.value[int(dim)]), one.column(5).to_numpy()
                    x = matrix(one.column(3).to_pylist(), raw)
                    home = grid.home(x)
                    row, cell = grid.visits(x, recall)
                    region = grid.regions(cell, side[row])
                    order = np.lexsort((cell, region, row))
                    row, cell, region = row[order], cell[order].astype("<u4"), region[order]
                    cut = runs(row * (int(region.max()) + 1) + region)
                    lists = [cell[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]
                    at = np.append(np.arange(len(x)), row[cut[:-1]])
                    cols = [one.column(k).take(pa.array(at)) for k in (0, 1, 2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.append(grid.regions(home, side), region[cut[:-1]]), pa.int64()), pa.array(home[at], pa.int64()), pa.array([None] * len(x) + lists, pa.binary())], ["c", "label", "dim", "v", "n", "region", "home", "cells"])

    labels = classes.groupBy("label", "dim").agg(F.ceil(F.sqrt(F.count("*") / BLOCK)).cast("long").alias("side"))
    placed = saved(classes.join(labels, ["label", "dim"]).select("c", "label", "dim", "v", "n", "side").mapInArrow(traverse, "c long, label long, dim int, v binary, n long, region long, home long, cells binary"), "visits")
    place = ["label", "dim", "region"]
    blocks = placed.groupBy(*place).agg(F.count(F.when(F.col("cells").isNull(), 1)).alias("nv"), F.count("cells").alias("nq")).where("nv > 0 AND nq > 0")
    blocks = saved(blocks.select(*place, F.ceil(F.col("nv") / BLOCK).alias("bv"), F.ceil(F.col("nq") / BLOCK).alias("bq")), "blocks")
    query = F.col("cells").isNotNull()
    mine, all_ = F.when(query, F.col("bq")).otherwise(F.col("bv")), F.when(query, F.col("bv")).otherwise(F.col("bq"))
    each = placed.join(blocks, place).withColumn("x", F.pmod(F.xxhash64("c"), mine)).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), all_ - 1)))
    part = F.xxhash64(*place, F.when(query, F.col("y")).otherwise(F.col("x")), F.when(query, F.col("x")).otherwise(F.col("y")))
    dealt = each.select(part.alias("part"), "dim", "c", "n", "v", "home", "cells")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in grouped(batches, "part"):
            cut = runs(p["part"].to_numpy())
            out = [links_of(p.iloc[s:e], Grid.of(held.value[int(p["dim"].iloc[s])]), raw, cosine, recall) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(3)], ["a", "b", "n"])

    links = saved(dealt.repartition("part").sortWithinPartitions("part", "c").mapInArrow(compare, "a long, b long, n long"), "links")
    other = links.where("a = b").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("others"))
    edges = links.select("a", "b")
    if several:
        named = own.join(classes.select(*vector, "c"), vector)
        edges = edges.unionByName(named.join(named.groupBy("i").agg(F.min("c").alias("b")), "i").select(F.col("c").alias("a"), "b"))
    joined = classes.drop("v").join(components(edges).select(F.col("node").alias("c"), "component"), "c", "left").join(other, "c", "left")
    joined = joined.select(*classes.drop("v", "n").columns, (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "c").alias("component"))
    if several:
        joined = saved(joined, "named")
        joined = joined.drop("c").join(joined.groupBy("component").agg(F.min("low").alias("c")), "component").withColumn("component", F.col("c"))
    found = own.join(saved(joined.select(*vector, "links", "component"), "joined"), vector).groupBy("i").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    out = rows.select("i").join(found, rows["i"] == found["i"], "left").select(rows["i"].alias("i"), "links", "component")
    best = F.coalesce(F.col("component").cast(kind), F.col("i"))
    return out.select(F.col("i").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), best.alias("component_id"), F.coalesce(best == F.col("i"), F.lit(True)).alias("kept"))


def links_of(p: pd.DataFrame, grid: Grid, raw: str, cosine: float, recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n): of a block of visitors and a block of vectors the links counted for a (where b = a), and a spanning forest of them (n = 0)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    query = p["cells"].notna().to_numpy()
    q, v = p[query], p[~query].sort_values("home", kind="stable")
    if not len(q) or not len(v):
        return none
    x, y = matrix(list(q["v"]), raw), matrix(list(v["v"]), raw)
    qc, vc, weight, others, home = q["c"].to_numpy(), v["c"].to_numpy(), v["n"].to_numpy(), q["n"].to_numpy(), q["home"].to_numpy()
    lists = [np.frombuffer(c, "<u4") for c in q["cells"]]
    cell = np.concatenate(lists).astype(np.int64)
    who = np.repeat(np.arange(len(q)), [len(c) for c in lists])
    order = np.argsort(cell, kind="stable")
    cell, who = cell[order], who[order]
    cut, found = runs(v["home"].to_numpy()), []
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        c = int(v["home"].iloc[s])
        a = who[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")]
        near = (x[a] @ y[s:e].T >= cosine) & (qc[a][:, None] != vc[s:e][None])
        i = np.flatnonzero(near.any(1))
        if len(i):
            found.append((a[i], s, e, np.packbits(near[i], axis=1)))
    if not found:
        return none
    names, at = np.unique(np.append(qc, vc), return_inverse=True)
    qa, va, root = at[: len(q)], at[len(q) :], np.arange(len(names))
    total, far, hits = np.zeros(len(q), np.int64), np.zeros(len(v), np.int64), []
    for a, s, e, bits in found:
        near = np.unpackbits(bits, axis=1, count=e - s).astype(bool)
        hits.append(s + np.flatnonzero(near.any(0)))
        total[a] += near @ weight[s:e]
        i, j = np.nonzero(near)
        root = roots(len(names), root[qa[a][i]], root[va[s:e][j]])[root]
    # a link that the other side does not find is counted for it here
    hit = np.concatenate(hits)
    of, visited = grid.visits(y[hit], recall)
    back = np.sort(hit[of] * (1 << 33) + visited)
    for a, s, e, bits in found:
        near = np.unpackbits(bits, axis=1, count=e - s).astype(bool)
        i, j = np.nonzero(near)
        key = (s + j) * (1 << 33) + home[a][i]
        k = np.minimum(np.searchsorted(back, key), len(back) - 1)
        unseen = back[k] != key
        np.add.at(far, s + j[unseen], others[a[i[unseen]]])
    some, more = np.flatnonzero(total), np.flatnonzero(far)
    o = np.flatnonzero(root != np.arange(len(names)))
    return np.concatenate([qc[some], vc[more], names[o]]), np.concatenate([qc[some], vc[more], names[root[o]]]), np.concatenate([total[some], far[more], np.zeros(len(o), np.int64)])


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label.
OP4_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS MATERIALIZED (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
g AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM g GROUP BY a),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT g.b, r.root FROM r JOIN g ON r.vec_id = g.a)
SELECT x.vec_id, coalesce(n.n, 0) AS n_links, root AS component_id, root = x.vec_id AS kept
FROM embeddings x LEFT JOIN n ON n.a = x.vec_id JOIN (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id) m ON m.vec_id = x.vec_id
"""
