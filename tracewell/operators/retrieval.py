"""Keyword and embedding retrieval over postings.

A corpus is turned into postings (doc, term, tf) once; queries join them on their few terms, so a search reads the lists of these terms only when postings are stored by term.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import fingerprint
from ..functions.text import index_tokens, path_tokens
from ..sources.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1, B = 1.5, 0.75
#: Hits and query terms of a block, about: what one task holds.
BLOCK_HITS, BLOCK_TERMS = 1_000_000, 1_000_000
#: How often each field's tokens count.
FIELDS = {"path": 5, "fingerprint": 3, "content": 1}


def postings(corpus: DataFrame, doc: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc, term, tf) of a corpus. Texts are dealt by document before they are cut, so a document's terms are counted in one task and no single word is shuffled."""
    dealt = corpus.select(F.col(doc).alias("doc"), F.col(content).alias("content")).repartition("doc")
    return dealt.select("doc", F.explode(index_tokens(F.col("content"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def weighted_postings(corpus: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, term, tf) with the fields of a document weighed: the path's tokens five times, its fingerprint's three times, the content's once."""
    field = lambda tokens, w: corpus.select(F.col(doc).alias("doc"), F.explode(tokens).alias("term"), F.lit(w).alias("w"))
    all_ = field(path_tokens(F.col("path")), FIELDS["path"]).unionByName(field(index_tokens(fingerprint(F.col("content"))), FIELDS["fingerprint"])).unionByName(field(index_tokens(F.col("content")), FIELDS["content"]))
    return all_.groupBy("doc", "term").agg(F.sum("w").alias("tf"))


def statistics(post: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, df), (doc, dl), and one row with n and avgdl."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    dl = post.groupBy("doc").agg(F.sum("tf").alias("dl"))
    return df, dl, dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(post: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, doc, score, rank): the k best documents of each query (q, term). Only the lists of the queries' terms are scored. Postings are read several times: give a written table."""
    terms = written(queries.select("q", "term").distinct(), "asked")
    hit = post.join(terms.select("term").distinct(), "term", "left_semi")  # the lists of the queries' terms
    _, dl, total = statistics(post)
    df = written(hit.groupBy("term").agg(F.count("*").alias("df")), "df")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    s = hit.join(df, "term").join(dl, "doc").crossJoin(F.broadcast(total)).select("term", "doc", (idf * tf).alias("s"))
    return best(s, terms.withColumn("w", F.lit(1.0)), df, k)


def best(hits: DataFrame, asked: DataFrame, df: DataFrame, k: int) -> DataFrame:
    """(q, doc, score, rank): the k best documents of each query by the sum of w * s over its terms, rounded to six places; equal ones by document.

    hits: term, doc, s (positive), each pair once; asked: q, term, w (positive), each pair once; df: term, df, how many hits a term has.
    Pairs of query and document are never rows: documents are dealt by hash to blocks of about BLOCK_HITS hits, queries to blocks of about BLOCK_TERMS terms, and where two blocks meet a task sums a query at a time over the documents of its block and keeps its k best. Work grows with the pairs, memory and what is shuffled do not.
    """
    numbered = written(df.select("term", "df", F.monotonically_increasing_id().alias("tid")), "terms")  # numbers stand for terms in blocks
    n_hits = numbered.agg(F.sum("df")).first()[0] or 0
    n_asked = asked.count()
    docs, queries = -(-n_hits // BLOCK_HITS) or 1, -(-n_asked // BLOCK_TERMS) or 1
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = numbered.select("term", "tid")
    left = hits.where("doc IS NOT NULL").join(number, "term").select(block("doc", docs).alias("b"), copies(queries).alias("c"), "tid", "doc", "s")
    right = asked.where("q IS NOT NULL").join(number, "term").select(copies(docs).alias("b"), block("q", queries).alias("c"), F.col("tid").alias("asked"), "q", "w")

    def meet(hit: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if hit.empty or ask.empty:
            return pd.DataFrame({"q": ask["q"].iloc[:0], "doc": hit["doc"].iloc[:0], "score": np.empty(0)})
        at, doc = pd.factorize(hit["doc"], sort=True)
        order = np.argsort(hit["tid"].to_numpy(), kind="stable")
        tids, at, s = hit["tid"].to_numpy()[order], at[order], hit["s"].to_numpy()[order]
        ask = ask.sort_values(["q", "asked"], ignore_index=True)
        lo, hi = np.searchsorted(tids, ask["asked"].to_numpy(), "left"), np.searchsorted(tids, ask["asked"].to_numpy(), "right")
        w, q = ask["w"].to_numpy(), ask["q"]
        starts = np.flatnonzero(np.r_[True, q.to_numpy()[1:] != q.to_numpy()[:-1]])
        found, scores, sizes = [], [], []
        for a, z in zip(starts, [*starts[1:], len(q)], strict=True):
            sums = np.zeros(len(doc))
            for i in range(a, z):
                sums[at[lo[i]:hi[i]]] += w[i] * s[lo[i]:hi[i]]  # a document is once in a list
            some = np.flatnonzero(sums)
            score = np.floor(sums[some] * 1e6 + 0.5)
            if len(some) > k:
                least = np.partition(score, len(some) - k)[len(some) - k]
                some, score = some[score >= least], score[score >= least]
            first = np.argsort(-score, kind="stable")[:k]  # documents are in order
            found.append(some[first])
            scores.append(score[first] / 1e6)
            sizes.append(len(first))
        return pd.DataFrame({"q": q.iloc[np.repeat(starts, sizes)].to_numpy(), "doc": np.asarray(doc)[np.concatenate(found)], "score": np.concatenate(scores)})

    types = {"q": asked.schema["q"].dataType, "doc": hits.schema["doc"].dataType}
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in types.items()) + ", score double"
    return ranked(left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(meet, schema), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)


def tfidf(post: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, doc, score, rank) by cosine; a query's weight of a term is its idf, a document's norm is over all its terms. Postings are read several times: give a written table."""
    df, dl, _ = statistics(post)
    return by_cosine(post, written(df, "df"), written(queries.select("q", "term").distinct(), "asked"), F.lit(dl.count()), k)


def by_cosine(post: DataFrame, df: DataFrame, terms: DataFrame, n: Column, k: int) -> DataFrame:
    """As `tfidf`, of postings (term, doc, tf), the number of documents that each term has (term, df), queries (q, term) and the number of documents with terms."""
    idf = df.select("term", "df", (F.ln((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    w = F.col("tf") * F.col("idf")
    norm = post.join(idf, "term").groupBy("doc").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    lists = idf.join(terms.select("term").distinct(), "term", "left_semi")
    asked = terms.join(lists, "term")
    qn = asked.groupBy("q").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("qn"))
    asked = asked.join(qn, "q").select("q", "term", (F.col("idf") / F.col("qn")).alias("w"))
    hits = post.join(lists, "term").join(norm, "doc").select("term", "doc", (w / F.col("norm")).alias("s"))
    return best(hits, asked, lists.select("term", "df"), k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def reranked(candidates: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int) -> DataFrame:
    """Candidates (q, doc, score) by 0.6 of their share of the best keyword score and 0.4 of their cosine with the query."""
    top = F.max("score").over(Window.partitionBy("q"))
    c = candidates.withColumn("part", F.col("score") / F.when(top > 0, top).otherwise(1.0)).join(vectors, "doc", "left").join(query_vectors, "q")
    final = 0.6 * F.col("part") + 0.4 * F.coalesce(cosine(F.col("v"), F.col("qv")), F.lit(0.0))
    return ranked(c.select("q", "doc", F.round(final, 6).alias("score")), k)


def stop_at_budget(rows: DataFrame, keys: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Rows in order up to the first that does not fit: a running sum, since sizes are not negative."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
