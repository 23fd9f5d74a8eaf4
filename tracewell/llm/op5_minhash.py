"""MinHash near-dedup by a chosen-path set similarity join.

1. Documents with the same set of shingles are one class; the classes are represented by their smallest id, so copies are never paired.
2. Each class has SIG minwise hashes. In each of TREES independent trees a document walks from the root: the node that it has come to chooses which of its minwise tokens comes next, and that token leads to the child. At depth DEPTH a node's documents have agreed in all chosen tokens.
3. Nodes of at most SMALL documents are compared exhaustively, by sketches of one bit of each minwise hash; what may be similar is linked to the node's smallest id. Larger nodes branch on: at each level a node chooses one or more of the tokens, 1 / threshold of them on average, and its documents go on by each. So of two documents at the threshold one child holds both on average, however deep they go. What is still together in a large node at the last depth is linked to its smallest id without a look. These are candidates, so this can only add work, not links.
4. Candidate components are confirmed on full sets. Small components are compared whole in one task, long as no path of confirmed links joins two documents already. In a large one every document is first compared with the component's smallest. The documents that this does not join meet the others again in trees of that component's documents alone: only those of whose minwise hashes enough agree (a byte of each is compared) take their sets to the node and are compared. Those of a node that may be alike stand side by side and are compared by pairs of blocks that hold such a pair; large nodes of the last depth are compared in all their blocks.
5. The components of confirmed links are the result.

A pair of similarity s is together in a tree at DEPTH with probability s^4, so in none of the trees with (1 - s^4)^24: 7e-8 at 0.85. Where all nodes on the way are crowded down to the last depth, 0.977 of 2,000 pairs at a threshold of 0.85 met in some tree (0.990 at depth 12), 0.933 at a threshold of 0.8; of pairs 0.05 above it 0.998 and 0.989.
A comparison on full sets or whole texts holds two blocks, each of at most BLOCK_BYTES of texts or sets, or one document that alone has more: small components have at most BLOCK documents, blocks of nodes at most SMALL; where blocks are dealt by hash (large components with their smallest, crowds) BLOCK documents and BLOCK_BYTES are means. A node of at most SMALL documents is compared by sketches in one task: 16 or 128 bytes a document. Rows grow with the documents: a set for each tree and each block that it may be alike to, and for each branch below a crowded node.

Shingles are of `shingle` words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased), identified by a 64-bit hash, sets by 128 bits; a text with fewer words has one shingle, the whole sequence; one without words has none and links with nothing.
Very long texts are whole sets like others. Nulls: a null text has no shingles. A null id is a document that links with nothing. Ids have to be whole numbers. An empty table has no rows; other columns are not read. Rows with the same id and different sets are distinct sets of that one id: n_shingles is each row's own, links of any of them count for the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLD, components, flat, grouped, in_pieces, lower_ascii, mix, prefix_hash, runs, saved, span_hash

SIG, TREES, DEPTH, LAST_DEPTH, SMALL, BLOCK, BLOCK_BYTES = 128, 24, 4, 16, 2048, 128, 16 << 20
#: A sketch agrees in p of its bits where the sets' similarity is about 2p - 1: candidates are sought with this margin below the threshold, over 4 standard deviations.
MARGIN = 0.25
#: The same for a byte of each minwise hash, where the share of equal bytes is about the similarity; and the rows of a node that are compared with all its others at a time.
BYTE_MARGIN, STRIPE = 0.16, 256


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, sorted within the row, and the n+1 offsets of rows."""
    data, off = flat(column)
    n = len(off) - 1
    row_of = np.repeat(np.arange(n), np.diff(off))
    d = np.full(len(data) + n, 32, np.uint8)  # a space after each row
    d[np.arange(len(data)) + row_of] = lower_ascii(data)
    off = off + np.arange(n + 1)
    gap = (d == 32) | ((d >= 9) & (d <= 13))
    word = ~gap
    start = np.flatnonzero(word & np.append(True, gap[:-1]))
    end = np.flatnonzero(gap & np.append(False, word[:-1]))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = span_hash(prefix_hash(d), start, end)
    first = np.searchsorted(start, off)  # first word of each row
    count = np.diff(first)
    row = np.repeat(np.arange(n), count)
    left = np.repeat(first[1:], count) - np.arange(len(h))
    out = mix(h)
    for k in range(1, size):
        nxt = np.zeros(len(h), np.uint64)
        nxt[: max(0, len(h) - k)] = h[k:]
        out = np.where(left > k, mix(out * GOLD + nxt), out)  # shorter at a row's end: kept only if it is the whole row
    whole = (count < size)[row]
    at = np.arange(len(h)) - np.repeat(first[:-1], count)
    keep = np.where(whole, at == 0, left >= size)
    out, row = out[keep], row[keep]
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.append(True, (out[1:] != out[:-1]) | (row[1:] != row[:-1])) if len(out) else np.zeros(0, bool)
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(n + 1))


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SIG minwise hashes of 32 bits for each row; rows without shingles have zeros."""
    n = len(off) - 1
    rng = np.random.default_rng(11)
    a = rng.integers(1, 1 << 32, SIG, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, SIG, dtype=np.uint32)
    out = np.zeros((n, SIG), np.uint32)
    some = np.flatnonzero(np.diff(off))
    low, high = sets.astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(some), 64):
        rows = some[lo : lo + 64]
        s, e = off[rows[0]], off[rows[-1] + 1]
        x, y, at = low[s:e], high[s:e], off[rows] - s
        for i in range(SIG):
            z = x * a[i] + b[i]
            z ^= y
            z *= np.uint32(0x85EBCA6B)
            out[rows, i] = np.minimum.reduceat(z, at)
    return out


def path_keys(sig: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """The node that each row has come to in a tree: at each node, a hash of the way there chooses the next token."""
    node = np.full(len(sig), tree + 1, np.uint64) * GOLD
    rows = np.arange(len(sig))
    for _ in range(depth):
        node = mix(node)
        i = (node % np.uint64(SIG)).astype(np.int64)
        node = mix(node * GOLD + sig[rows, i].astype(np.uint64) + (i.astype(np.uint64) << np.uint64(32)))
    return node


def branches(node: np.ndarray, sig: np.ndarray, levels: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, nodes): where each row comes to from its node within some levels, if a node chooses 1 / threshold tokens on average."""
    rows = np.arange(len(sig))
    least, more = divmod(1 / threshold, 1)
    for _ in range(levels):
        node = mix(node)
        count = int(least) + ((mix(node ^ GOLD) >> np.uint64(11)).astype(np.float64) / (1 << 53) < more)
        rows, node = np.repeat(rows, count), np.repeat(node, count)
        k = (np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        way = mix(node + k * GOLD)
        i = (way % np.uint64(SIG)).astype(np.int64)
        node = mix(way * GOLD + sig[rows, i].astype(np.uint64) + (i.astype(np.uint64) << np.uint64(32)))
    return rows, node


def sketches(sig: np.ndarray) -> np.ndarray:
    """A bit of each minwise hash, after a mix: the lowest bit alone would follow the token's own."""
    return np.packbits(((sig * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8), axis=1)


def hash_bytes(sig: np.ndarray) -> np.ndarray:
    """A byte of each minwise hash, after a mix."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def alike_bytes(rows: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows may be similar, by their bytes."""
    out, columns = np.empty((len(rows), len(rows)), bool), np.ascontiguousarray(rows.T)
    for lo in range(0, len(rows), STRIPE):
        same = np.zeros((len(rows[lo : lo + STRIPE]), len(rows)), np.uint8)
        for column in columns:
            same += column[lo : lo + STRIPE, None] == column[None]
        out[lo : lo + STRIPE] = same >= least * SIG
    return out


def alike(sketch: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows may be similar, by their sketches."""
    words = np.ascontiguousarray(sketch).view(np.uint64).T
    out = np.empty((len(sketch), len(sketch)), bool)
    for lo in range(0, len(sketch), STRIPE):
        apart = sum(np.bitwise_count(w[lo : lo + STRIPE, None] ^ w[None]) for w in words)
        out[lo : lo + STRIPE] = apart <= (1 - least) * SIG / 2
    return out


def smallest_joined(pairs: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row the smallest id that it reaches over a matrix of pairs."""
    low = c.copy()
    while True:
        new = np.concatenate([np.where(pairs[lo : lo + STRIPE], low[None], low[lo : lo + STRIPE, None]).min(1) for lo in range(0, len(c), STRIPE)])
        if (new == low).all():
            return low
        low = new


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def jaccard_links(sets: list[np.ndarray], percent: int, against: range | None = None, root: np.ndarray | None = None) -> np.ndarray:
    """Roots of the rows by links with 100 * intersection >= percent * union; a pair that is joined already is not compared.

    against: only pairs with one side in this range are compared.
    """
    n = len(sets)
    root = np.arange(n) if root is None else root.copy()
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    ids = np.concatenate(sets)
    uniq, inv = np.unique(ids, return_inverse=True)
    mark = np.zeros(len(uniq), bool)
    off = np.append(0, np.cumsum(sizes))
    for k, i in enumerate(order):
        later = order[k + 1 :]
        if against is not None and i not in against:
            later = later[(later >= against.start) & (later < against.stop)]
        later = later[(100 * sizes[i] >= percent * sizes[later]) & (root[later] != root[i])]
        if not len(later) or not sizes[i]:
            continue
        mark[:] = False
        mark[inv[off[i] : off[i + 1]]] = True
        for j in later:
            if root[j] == root[i]:
                continue
            both = int(mark[inv[off[j] : off[j + 1]]].sum())
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                root[(root == root[i]) | (root == root[j])] = min(root[i], root[j])
    return root


def block_pairs(pair: np.ndarray, g: np.ndarray, c: np.ndarray, near: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(block, block, rows, which of them ask) so that every pair of rows that may be alike, one of which is not near, is in one of them.

    Rows that are joined by such pairs stand side by side, so few blocks of many have a pair. A block is of one component (g), and has at most BLOCK_BYTES, or one row; its rows are a node's, SMALL at most.
    """
    order = np.lexsort((c, smallest_joined(pair, c), g))
    order = order[pair[order].any(1)]
    block, at, volume = np.zeros(len(order), np.int64), 0, 0
    for k, i in enumerate(order):
        if k and (g[i] != g[order[k - 1]] or volume + size[i] > BLOCK_BYTES):
            at, volume = at + 1, 0
        block[k], volume = at, volume + int(size[i])
    cut = runs(block)
    near = near[order]
    pair = pair[np.ix_(order, order)]
    for q, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        own = pair[x:y, x:y].any(1)
        if own.any():
            yield q, q, order[x:y][own], ~near[x:y][own]
        for k in range(len(cut) - 1):
            z, e = cut[k], cut[k + 1]
            met = pair[x:y, z:e] & ~near[x:y, None]
            if k < q:
                met = met & near[None, z:e]  # two that are not near meet once
            if k != q and met.any():
                asks, told = np.flatnonzero(met.any(1)), np.flatnonzero(met.any(0))
                yield q, k, np.concatenate([order[x:y][asks], order[z:e][told]]), np.append(np.ones(len(asks), bool), np.zeros(len(told), bool))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, set_key, n_shingles, component_id, kept): one row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "t", 1 << 20):
            sets, off = shingles(b.column(1), shingle)
            n_bytes = np.diff(flat(b.column(1))[1])
            sig = signatures(sets, off)
            count = np.diff(off)
            some = count > 0
            total = np.append(np.uint64(0), np.cumsum(mix(sets), dtype=np.uint64))
            key = mix((total[off[1:]] - total[off[:-1]]) + count.astype(np.uint64) * GOLD)
            total = np.append(np.uint64(0), np.cumsum(mix(sets ^ GOLD), dtype=np.uint64))
            pair = np.stack([key, mix(total[off[1:]] - total[off[:-1]])], 1).astype("<u8")
            rows = np.ascontiguousarray(sig.astype("<u4")).view(f"S{4 * SIG}").ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in pair], pa.binary()), pa.array(count, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array([r.ljust(4 * SIG, b"\0") if s else None for r, s in zip(rows.tolist(), some, strict=True)], pa.binary())],
                ["i", "set_key", "n_shingles", "n_bytes", "sig"],
            )

    signed_docs = saved(src.mapInArrow(sign, f"i {kind}, set_key binary, n_shingles long, n_bytes long, sig binary"), "signatures")
    usable = signed_docs.where("i IS NOT NULL AND n_shingles > 0")
    classes = saved(usable.groupBy("set_key").agg(F.min("i").cast("long").alias("c"), F.max("n_bytes").alias("n_bytes"), F.first("sig").alias("sig")), "classes")
    members = usable.join(classes.select("set_key", "c").hint("merge"), "set_key").select(F.col("i").cast("long").alias("a"), F.col("c").alias("b"))
    held = saved(components(saved(candidate_links(classes, percent / 100), "candidates")).select(F.col("node").alias("c"), F.col("component").alias("g")), "groups")
    if usable.groupBy("i").count().where("count > 1").limit(1).count():
        src = src.dropDuplicates(["i", "t"])  # rows that repeat
    links = confirmed_links(src, held, classes, shingle, percent)
    found = components(links.unionByName(members.where("a <> b")))
    out = signed_docs.join(found.select(F.col("node").alias("i"), "component"), "i", "left")
    best = F.coalesce(F.col("component").cast(kind), F.col("i"))
    return out.select(F.col("i").alias(id_col), "set_key", "n_shingles", best.alias("component_id"), F.coalesce(best == F.col("i"), F.lit(True)).alias("kept"))


def nodes(classes: DataFrame, threshold: float, most: int, sketch_of) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (node, c, sketch) of the nodes of at most `most` documents, one for each depth at which some were reached; and of the larger ones at the last depth, if there are any. Nodes of one document are left out."""

    def roots_of_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, sig, _ in signed_rows(batches):
            sketch = pa.array([r.tobytes() for r in sketch_of(sig)], pa.binary())
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([signed(path_keys(sig, t, DEPTH)), c, sketch], ["node", "c", "sketch"])

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, sig, part in signed_rows(batches):
            rows, node = branches(part.column(part.schema.get_field_index("node")).to_numpy().view(np.uint64), sig, 4, threshold)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([signed(node), c.take(take), pa.array([r.tobytes() for r in sketch_of(sig)], pa.binary()).take(take)], ["node", "c", "sketch"])

    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.RecordBatch]]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                raw, _ = flat(part.column(part.schema.get_field_index("sig")))
                yield part.column(part.schema.get_field_index("c")), raw.view("<u4").reshape(-1, SIG), part

    rows = "node long, c long, sketch binary"
    now, depth, found = classes.select("c", "sig").mapInArrow(roots_of_trees, rows), DEPTH, []
    while True:
        # merge joins at every size: what is joined grows with the documents
        sizes = saved(now.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", (F.col("n") > most).alias("big")), f"nodes{depth}")  # written, so that Spark can split the join on a node with many documents
        shared = saved(now.join(sizes.hint("merge"), "node"), f"shared{depth}")  # a node of one document is a leaf
        found.append(shared.where("NOT big").select("node", "c", "sketch"))
        big = shared.where("big")
        if not big.limit(1).count():
            return found, None
        if depth >= LAST_DEPTH:
            return found, big.select("node", "c")
        depth += 4
        again = saved(big.select("c", "node").join(classes.select("c", "sig"), "c").select("c", "node", "sig"), f"big{depth}")
        now = again.mapInArrow(go_on, rows)


def candidate_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of classes to the smallest id among what is alike in a node of some tree."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in grouped(batches, "node"):
            node, c = p["node"].to_numpy(), p["c"].to_numpy()
            sketch = np.frombuffer(b"".join(p["sketch"]), np.uint8).reshape(len(p), -1)
            cut, a, b = runs(node), [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s < 2:
                    continue
                low = smallest_joined(alike(sketch[s:e], threshold - MARGIN), c[s:e])
                other = low != c[s:e]
                a.append(c[s:e][other])
                b.append(low[other])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    small, crowd = nodes(classes, threshold, SMALL, sketches)
    links = reduce(DataFrame.unionByName, [t.repartition("node").sortWithinPartitions("node", "c").mapInArrow(compare, "a long, b long") for t in small])
    if crowd is not None:
        least_c = saved(crowd.groupBy("node").agg(F.min("c").alias("b")), "least")
        links = links.unionByName(crowd.join(least_c, "node").where("c <> b").select(F.col("c").alias("a"), "b"))
    return links.distinct()


def confirmed_links(docs: DataFrame, held: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links between documents of a candidate component that hold on their full sets, enough to join what is linked."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_bytes") / BLOCK_BYTES))
    weighed = held.join(classes.groupBy("c").agg(F.max("n_bytes").alias("n_bytes")), "c")
    sizes = saved(weighed.groupBy("g").agg(blocks.alias("n"), (blocks > 1).alias("large")), "sizes")
    texts = saved(docs.select(F.col("i").cast("long").alias("c"), "t").join(held.join(sizes, "g").hint("merge"), "c"), "texts", codec="zstd")
    out = "a long, b long"
    least = percent / 100 - BYTE_MARGIN

    def sets_of(texts) -> list[np.ndarray]:
        """The sets of texts, made from about a MB of them at a time."""
        found: list[np.ndarray] = []
        part = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["t"])
        for b in in_pieces(iter([part]), "t", 1 << 20, last=False):
            sets, off = shingles(b.column(0), shingle)
            found += [sets[x:y] for x, y in zip(off[:-1], off[1:], strict=True)]
        return found

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in grouped(batches, "g"):
            cut = runs(p["g"].to_numpy())
            c, a, b = p["c"].to_numpy(), [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                root = jaccard_links(sets_of(p["t"].iloc[s:e]), percent)
                other = np.flatnonzero(root != np.arange(e - s))
                a += c[s:e][other].tolist()
                b += c[s:e][root[other]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    small = texts.where("NOT large").select("g", "c", "t")
    links = small.repartition("g").sortWithinPartitions("g", "c").mapInArrow(whole, out)
    if not sizes.where("large").limit(1).count():
        return saved(links, "links")

    # large components: their sets once, each block of them with the set of the component's smallest id
    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "t", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.tobytes() for x in sets_of(b.column(3))], pa.binary())], ["g", "c", "n", "s"])

    sets = saved(texts.where("large").select("g", "c", "n", "t").mapInArrow(as_sets, "g long, c long, n long, s binary"), "sets")
    part = F.xxhash64("g", "x").alias("part")
    pivots = sets.where("c = g").groupBy("g").agg(F.min("s").alias("s"), F.first("n").alias("n")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = sets.withColumn("x", F.pmod(F.xxhash64("c"), F.col("n"))).select(part, "g", "c", "s", F.lit(False).alias("pivot")).unionByName(pivots.select(part, "g", F.col("g").alias("c"), "s", F.lit(True).alias("pivot")))

    def with_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in grouped(batches, "part"):
            pivot = {k: np.frombuffer(s, np.uint64) for k, s in p.loc[p["pivot"], ["part", "s"]].itertuples(index=False)}
            p = p[~p["pivot"]]
            near = []
            for k, s in zip(p["part"], p["s"], strict=True):
                x, y = np.frombuffer(s, np.uint64), pivot[k]
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(bool(len(x)) and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array(p["g"], pa.int64()), pa.array(p["c"], pa.int64()), pa.array(near, pa.bool_()), pa.array(p["s"].str.len(), pa.int64())], ["g", "c", "near", "size"])

    tested = saved(dealt.repartition("part").sortWithinPartitions("part", "c").mapInArrow(with_pivot, "g long, c long, near boolean, size long"), "tested")
    links = links.unionByName(tested.where("near AND c <> g").select(F.col("c").alias("a"), F.col("g").alias("b")))
    left = saved(tested.groupBy("g").agg(F.count(F.when(~F.col("near"), 1)).alias("left")).where("left > 0").select("g"), "left")
    open_ = saved(tested.groupBy("g", "c").agg(F.min("near").alias("near"), F.max("size").alias("size")).join(left, "g"), "open")

    # what the smallest does not join meets the rest in the nodes of the trees
    def tickets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in grouped(batches, "node"):
            node, g, c, near, size = (p[k].to_numpy() for k in ("node", "g", "c", "near", "size"))
            sketch = np.frombuffer(b"".join(p["sketch"]), np.uint8).reshape(len(p), -1)
            cut, rows, parts, query = runs(node), [], [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                pair = alike_bytes(sketch[s:e], least) & (g[s:e][:, None] == g[s:e][None]) & ~(near[s:e][:, None] & near[s:e][None])
                np.fill_diagonal(pair, False)
                for q, k, some, asks in block_pairs(pair, g[s:e], c[s:e], near[s:e], size[s:e]):
                    rows.append(s + some)
                    parts.append(np.full(len(some), q << 20 | k))
                    query.append(asks)
            if rows:
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((node[at], pa.int64()), (np.concatenate(parts), pa.int64()), (c[at], pa.int64()), (near[at], pa.bool_()), (np.concatenate(query), pa.bool_()))], ["node", "pair", "c", "near", "query"])

    again = classes.join(open_.select("c").distinct(), "c", "left_semi").select("c", "sig")
    small, crowds = nodes(saved(again, "again"), percent / 100, SMALL, hash_bytes)
    asked = reduce(DataFrame.unionByName, small).join(open_, "c").repartition("node").sortWithinPartitions("node", "c").mapInArrow(tickets, "node long, pair long, c long, near boolean, query boolean")
    asked = asked.select(F.xxhash64("node", "pair").alias("part"), "c", "near", "query")
    if crowds is not None:  # all that is left in a crowd against all of it, in blocks
        crowd = saved(crowds.join(open_, "c").select("node", "g", "c", "near", "size"), "crowd")
        some = lambda which: F.ceil(F.greatest(F.count(F.when(which, 1)) / BLOCK, F.sum(F.when(which, F.col("size"))) / BLOCK_BYTES))
        blocks = crowd.groupBy("node", "g").agg(some(~F.col("near")).alias("nl"), some(F.lit(True)).alias("na")).where("nl > 0")
        rows = crowd.join(saved(blocks, "blocks"), ["node", "g"])
        part_of = lambda n: F.pmod(F.xxhash64("c"), F.col(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        queries = rows.where("NOT near").withColumn("q", part_of("nl")).select("*", each("na").alias("k")).withColumn("query", F.lit(True))
        targets = rows.withColumn("k", part_of("na")).select("*", each("nl").alias("q")).withColumn("query", F.lit(False))
        asked = asked.unionByName(queries.unionByName(targets).select(F.xxhash64("node", "g", "q", "k").alias("part"), "c", "near", "query"))
    met = saved(asked, "tickets").join(sets.select("c", "s"), "c")

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in grouped(batches, "part"):
            cut, a, b = runs(p["part"].to_numpy()), [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                own = p.iloc[s:e].drop_duplicates(["c", "s"], keep="first").sort_values(["query", "c"], ascending=[False, True])
                c = own["c"].to_numpy()
                near = own["near"].to_numpy()
                root = np.where(near, near.argmax(), np.arange(len(c)))  # joined by the component's smallest
                after = jaccard_links([np.frombuffer(x, np.uint64) for x in own["s"]], percent, range(int(own["query"].sum())), root)
                other = np.flatnonzero(after != root)
                a += c[other].tolist()
                b += c[after[other]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = links.unionByName(met.select("part", "c", "s", "near", "query").repartition("part").sortWithinPartitions("part", F.desc("query"), "c").mapInArrow(in_blocks, out))
    return saved(links, "links")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs by their common shingles, then the components by a recursive query.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[k + 1 : k + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS k FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.b, r.root FROM r JOIN g ON r.doc_id = g.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, root = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
"""
