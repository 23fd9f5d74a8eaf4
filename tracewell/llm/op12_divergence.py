"""Source divergence audit: how each source of a language differs from the others, and by which terms.

1. A byte-level tokenizer cuts terms on executors: texts are laid end to end as UTF-8 bytes, a lookup table of 256 entries tells the bytes of terms (and lower-cases A-Z), and changes of that class and the ends of texts are the boundaries. Bytes of letters beyond ASCII are all 128 or more, so no character is cut.
2. Slices are grouped by their xxhash, and each is compared with its group's first slice byte by byte; those that differ are told apart by their bytes. Occurrences and documents are counted within a piece of PIECE bytes, then by Spark, before and after the shuffle.
3. A language keeps the terms of at least `least_docs` of its documents.
4. Terms of a language are dealt to blocks by hash. A block is a CSR matrix of sources by terms; with smoothed shares p of every source, it gives each pair of sources its divergence over the block's terms, summed by reduceat over the rows' cells. Terms that a source lacks are not stored: what they add follows from sums over the other's cells and from the number of terms that both lack. A block has a bounded number of cells on average; only rows of sources meet in every block of their language.
5. Spark sums the blocks' divergences and ranks them.

All arithmetic is on whole numbers: p = 1 + floor(SCALE (n + 2) / (N + 2 V)), f = floor((p - q)^2 / (p + q)).
Nulls in text, lang and source count as ''. Empty texts have no terms, and their groups count all the same. A text longer than a piece is counted slice by slice, cut between terms. Rows that repeat are documents of their own. An empty table has no rows. Only the three columns are read, whatever others are called. Equal values are ranked by the bytes of the item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat, in_pieces, runs, saved

#: Fixed values of the query: bytes that are no part of a term, the scale of shares, documents that a term needs, ranks of terms.
NO_TERM = [*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
SCALE, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
#: Bytes of text that are cut at a time; cells of a block; the most cells that many sources may lift that to.
PIECE, CELLS, MOST_CELLS = 8 << 20, 1 << 15, 1 << 22
OF_TERM = np.ones(256, bool)
OF_TERM[NO_TERM] = False
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
COUNTS = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"


def slices(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all terms of texts that lie end to end."""
    inside = OF_TERM[data]
    cut = off[(off > 0) & (off < len(data))]
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    before[cut] = False
    after[cut - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether the slices of these sizes at a and at b are equal; some millions of bytes are compared at a time."""
    out = np.ones(len(a), bool)
    at = 0
    total = np.append(0, np.cumsum(size))
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        n = size[at:end]
        step = np.arange(total[end] - total[at]) - np.repeat(total[at:end] - total[at], n)
        differ = data[np.repeat(a[at:end], n) + step] != data[np.repeat(b[at:end], n) + step]
        out[at:end] = np.add.reduceat(differ, total[at:end] - total[at], dtype=np.int64) == 0
        at = end
    return out


def term_ids(lowered: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """A number for each slice, the same for equal bytes only, and the bytes of each number."""
    raw = lowered.tobytes()
    h = np.fromiter((hashed(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    order = np.argsort(h, kind="stable")
    first = runs(h[order])
    number = np.empty(len(h), np.int64)
    number[order] = np.repeat(np.arange(len(first) - 1), np.diff(first))
    head = order[first[:-1]]
    size, own = end - start, head[number]
    other = np.flatnonzero(own != np.arange(len(h)))
    equal = size[other] == size[own[other]]
    equal[equal] = same_bytes(lowered, start[other[equal]], start[own[other[equal]]], size[other[equal]])
    terms = [raw[start[k] : end[k]] for k in head.tolist()]
    more: dict[bytes, int] = {}
    for k in other[~equal].tolist():
        number[k] = more.setdefault(raw[start[k] : end[k]], len(terms) + len(more))
    return number, [*terms, *more]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text) to occurrences and documents of each term of each group; a group without terms has the term ''."""
    names = ["lang", "source", "term", "n", "docs"]

    def rows(lang: list[str], source: list[str], term: list[bytes], n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names)

    for b in in_pieces(batches, "text", PIECE):
        lang, source = (b.column(c).fill_null("").to_pandas() for c in range(2))
        (lc, ls), (sc, ss) = pd.factorize(lang), pd.factorize(source)
        group, kind = np.unique(lc * len(ss) + sc, return_inverse=True)
        gl, gs = [ls[k] for k in (group // len(ss)).tolist()], [ss[k] for k in (group % len(ss)).tolist()]
        yield rows(gl, gs, [b""] * len(group), np.zeros(len(group), np.int64), np.zeros(len(group), np.int64))
        data, off = flat(b.column(2))
        if len(data) > PIECE:  # one long text: its slices end between terms
            seen: Counter[bytes] = Counter()
            gaps = np.flatnonzero(~OF_TERM[data])
            at = 0
            while at < len(data):
                gap = np.searchsorted(gaps, at + PIECE)
                end = int(gaps[gap]) if gap < len(gaps) else len(data)
                s, e = slices(part := data[at:end], np.array([0, end - at]))
                number, terms = term_ids(LOWERED[part], s, e)
                seen.update(dict(zip(terms, np.bincount(number, minlength=len(terms)).tolist(), strict=True)))
                at = end
            found = list(seen)
            for lo in range(0, len(found), 1 << 16):
                part = found[lo : lo + (1 << 16)]
                yield rows(gl * len(part), gs * len(part), part, np.array([seen[t] for t in part]), np.ones(len(part), np.int64))
            continue
        start, end = slices(data, off)
        if not len(start):
            continue
        number, terms = term_ids(LOWERED[data], start, end)
        doc, width = np.searchsorted(off, start, "right") - 1, len(terms)
        # occurrences in each document, then in each group
        cell, n = np.unique(doc * width + number, return_counts=True)
        key = kind[cell // width] * width + cell % width
        order = np.argsort(key, kind="stable")
        first = runs(key[order])
        n, docs, key = np.add.reduceat(n[order], first[:-1]), np.diff(first), key[order][first[:-1]]
        for lo in range(0, len(key), 1 << 16):
            k = key[lo : lo + (1 << 16)]
            g, t = (k // width).tolist(), (k % width).tolist()
            yield rows([gl[x] for x in g], [gs[x] for x in g], [terms[x] for x in t], n[lo : lo + (1 << 16)], docs[lo : lo + (1 << 16)])


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (n + 2) / whole) without a product of over 64 bits, in two steps of 10^5 and 10^4."""
    if len(n) and int(n.max()) > 90_000_000_000_000:
        raise OverflowError("a term has over 9e13 occurrences")
    up = (n + 2) * 100_000
    return 1 + up // whole * 10_000 + up % whole * 10_000 // whole


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def row_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a CSR matrix's rows, which may be empty."""
    out = np.zeros(len(first) - 1, np.int64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(x, first[full], dtype=np.int64)
    return out


def block_divergences(key: tuple[pa.Scalar, ...], block: pa.Table, top: int = TOP) -> pa.Table:
    """What one block of a language's terms adds: the divergence of each pair of sources, and the highest terms of each.

    block: (lang, block, source, term, n, whole, whole_lang); rows without a term are the language's sources with N + 2 V of each and of the language.
    """
    lang = key[0].as_py()
    p = block.select(["source", "term", "n", "whole", "whole_lang"]).to_pandas()
    own, cells = p[p["term"].isna()].sort_values("source"), p[p["term"].notna()]
    sources = own["source"].to_numpy(object)
    whole = own["whole"].to_numpy(np.int64)
    row = pd.Index(sources).get_indexer(cells["source"])
    col, terms = pd.factorize(cells["term"], sort=True)
    order = np.lexsort((col, row))
    row, col, n = row[order], col[order].astype(np.int64), cells["n"].to_numpy(np.int64)[order]
    first = np.searchsorted(row, np.arange(len(sources) + 1))
    filled, width = np.diff(first), len(terms)
    share, none = shares(n, whole[row]), shares(np.zeros(len(sources), np.int64), np.maximum(whole, 1))
    out: list[tuple[list[str], str, list[str], np.ndarray]] = []
    for g in range(len(sources)):
        a, z = first[g], first[g + 1]
        dense = np.full(width, none[g])
        dense[col[a:z]] = share[a:z]
        mine = np.zeros(width, bool)
        mine[col[a:z]] = True
        both = mine[col]
        met = row_sums(distance(share, dense[col]), first)  # over the other's cells
        alone = np.zeros(len(sources), np.int64)  # over this one's cells that the other lacks
        for lo in range(a, z, max(1, (1 << 20) // len(sources))):
            alone += distance(share[lo : min(z, lo + max(1, (1 << 20) // len(sources))), None], none[None, :]).sum(0)
        alone -= row_sums(np.where(both, distance(dense[col], none[row]), 0), first)
        lack = width - filled - filled[g] + row_sums(both, first)  # terms that neither has
        value = met + alone + lack * distance(none, none[g])
        rest = np.flatnonzero(np.arange(len(sources)) != g)
        out.append(([sources[g]] * len(rest), "pair", sources[rest].tolist(), value[rest]))
    if width:
        by_term = np.argsort(col, kind="stable")
        total = np.add.reduceat(n[by_term], np.searchsorted(col[by_term], np.arange(width)), dtype=np.int64)
        usual = shares(total, np.full(width, int(own["whole_lang"].iloc[0])))[col]
        value = distance(share, usual)
        over = np.flatnonzero((share > usual) & (n > 0))
        over = over[np.lexsort((col[over], -value[over], row[over]))]
        begins = np.searchsorted(row[over], np.arange(len(sources)))
        over = over[np.arange(len(over)) - begins[row[over]] < top]
        out.append((sources[row[over]].tolist(), "term", terms[col[over]].tolist(), value[over]))
    names = [f.split()[0] for f in PARTS.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64()]
    tables = [pa.table([pa.array([lang] * len(s), pa.string()), pa.array(s, pa.string()), pa.array([part] * len(s), pa.string()), pa.array(i, pa.string()), pa.array(v, pa.int64())], names) for s, part, i, v in out]
    return pa.concat_tables([*tables, pa.schema(list(zip(names, kinds, strict=True))).empty_table()])


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank). part `pair`: the divergence from each other source of the language; part `term`: the terms that set the source most apart from its language."""
    own = docs.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    cells = saved(own.mapInArrow(counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "cells", codec="zstd")
    term = Window.partitionBy("lang", "term")
    kept = cells.where("term <> ''").withColumn("in_lang", F.sum("docs").over(term)).withColumn("first", (F.min("source").over(term) == F.col("source")).cast("long"))
    kept = saved(kept.where(F.col("in_lang") >= least_docs).select("lang", "source", "term", "n", "first"), "kept", codec="zstd")
    # of each group and each language: N, and of the language V, its cells and its sources
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.sum("first").alias("firsts"), F.count("*").alias("cells"))
    groups = saved(cells.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0), "groups")
    langs = groups.groupBy("lang").agg(F.sum("own").alias("of_lang"), F.sum("firsts").alias("v"), F.sum("cells").alias("cells"), F.count("*").cast("long").alias("sources"))
    room = F.greatest(F.lit(CELLS), F.least(F.col("sources") * F.col("sources"), F.lit(MOST_CELLS)))
    langs = saved(langs.select("lang", "of_lang", "v", F.greatest(F.lit(1), F.ceil(F.col("cells") / room)).cast("int").alias("blocks")), "langs")
    facts = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), (F.col("own") + 2 * F.col("v")).alias("whole"), (F.col("of_lang") + 2 * F.col("v")).alias("whole_lang"))
    none = F.lit(None).cast("long")
    dealt = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n", none.alias("whole"), none.alias("whole_lang"))

    def block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return block_divergences(key, table, top)

    parts = saved(dealt.unionByName(facts).groupBy("lang", "block").applyInArrow(block, PARTS), "parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return pairs.unionByName(parts.where("part = 'term'")).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
occ AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS x FROM docs),
low AS (SELECT r, lang, source, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM occ),
kept AS MATERIALIZED (SELECT lang, term FROM low GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
cells AS MATERIALIZED (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM low JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
full_groups AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v.v
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 2)) // (total + 2 * v) AS HUGEINT) AS p FROM full_groups),
of_lang AS (SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term)),
q AS (SELECT o.lang, o.term, CAST(1 + (1000000000 * (o.n + 2)) // (o.total + 2 * v.v) AS HUGEINT) AS q FROM of_lang o JOIN v ON o.lang = v.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10
"""
