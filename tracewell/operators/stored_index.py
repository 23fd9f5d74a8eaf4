"""An inverted index on disk: segments of postings clustered by term, delta segments for what changed, tombstones, merges.

A segment is a folder with three Parquet tables: `postings` (term, doc, tf, dl), ranged by term and document and sorted, in small row groups, so that a filter on terms reads only the pages of those terms; `docs` (doc, mtime, doc_type, dl); `gone` (doc, gen), the tombstones: documents of older generations that this segment replaces or removes. Segments lie in a folder for each generation, `gen=1` and so on, a partition column when they are read. Ranges are by term and document, so the list of a term that every document has is spread over as many files as it needs.
A manifest names the segments and the totals of live documents. Each change writes a new manifest under the next number, which only one writer can create; readers take the highest. Nothing that a manifest names is ever changed, so a reader is never disturbed, and files of failed writers are never named. `vacuum` removes what the newest manifest does not name.

A document is known by its key. Nulls: rows without a key are left out; a null content has no terms, a null mtime is older than any. Of rows that repeat a key, the one with the highest mtime counts, and of these the one with the highest content.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import fingerprint
from ..functions.text import index_tokens, path_tokens
from ..sources.shared import written
from .retrieval import B, FIELDS, K1, best, by_cosine, ranked

#: Bytes of a row group; a search with at most so many terms filters the scan by them, one with more joins the lists.
ROW_GROUP, PUSHED_TERMS = 1 << 20, 200
#: Postings of a file of a segment, about.
FILE_ROWS = 4_000_000


@dataclass(frozen=True)
class Segment:
    name: str
    gen: int
    postings: int
    docs: int
    tokens: int
    gone: int


@dataclass(frozen=True)
class Manifest:
    version: int
    segments: list[Segment] = field(default_factory=list)
    docs: int = 0
    tokens: int = 0


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest state of an index; an empty one where there is none."""
    fs, where, path_of = _fs(spark, f"{path}/manifests")
    names = sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return Manifest(0)
    stream = fs.open(path_of(f"{path}/manifests/{names[-1]}"))
    try:
        found = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    return Manifest(found["version"], [Segment(**s) for s in found["segments"]], found["docs"], found["tokens"])


def _commit(spark: SparkSession, path: str, new: Manifest) -> Manifest:
    """Writes a manifest under its number; fails if another writer has it."""
    fs, where, _ = _fs(spark, f"{path}/manifests/{new.version:012d}.json")
    text = {"version": new.version, "segments": [vars(s) for s in new.segments], "docs": new.docs, "tokens": new.tokens}
    stream = fs.create(where, False)
    stream.write(bytearray(json.dumps(text).encode()))
    stream.close()
    return new


def terms_of(content: Column, path: Column | None = None) -> Column:
    """An array of terms, each as often as it weighs: the tokens of a content, or of path, fingerprint and content by the fields' weights."""
    weighed = lambda tokens, w: F.flatten(F.array_repeat(F.coalesce(tokens, F.array().cast("array<string>")), w))
    if path is None:
        return weighed(index_tokens(content), 1)
    return F.concat(weighed(path_tokens(path), FIELDS["path"]), weighed(index_tokens(fingerprint(content)), FIELDS["fingerprint"]), weighed(index_tokens(content), FIELDS["content"]))


def counted(terms: Column) -> Column:
    """An array of (term, tf) of an array of terms, in their order: counted within the row, so no single term is shuffled."""
    # an array is bound to a name, or it would be computed again for each of its elements
    bound = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    starts = lambda s: F.array_compact(F.transform(s, lambda t, k: F.when(~F.get(s, k - 1).eqNullSafe(t), k)))
    end = lambda s, at, k: F.coalesce(F.get(at, k + 1), F.size(s))
    pairs = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (end(s, at, k) - i).cast("long").alias("tf")))
    return bound(F.sort_array(terms), lambda s: bound(starts(s), lambda at: pairs(s, at)))


def _write(spark: SparkSession, path: str, gen: int, docs: DataFrame, postings: DataFrame, gone: DataFrame) -> Segment:
    """A segment of docs (doc, mtime, doc_type, dl), postings (term, doc, tf, dl) and gone (doc, gen)."""
    name = f"gen={gen}/{uuid.uuid4().hex}"
    where = f"{path}/segments/{name}"
    docs.write.parquet(f"{where}/docs")
    n, tokens = spark.read.schema(docs.schema).parquet(f"{where}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    gone.write.parquet(f"{where}/gone")
    # as many files as the documents' tokens, of which a posting has one or more
    parts = max(1, -(-int(tokens) // FILE_ROWS))
    ranged = postings.repartitionByRange(parts, "term", "doc").sortWithinPartitions("term", "doc")
    ranged.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", 2000).parquet(f"{where}/postings")
    return Segment(name, gen, spark.read.parquet(f"{where}/postings").count(), n, int(tokens), spark.read.schema(gone.schema).parquet(f"{where}/gone").count())


def _table(spark: SparkSession, path: str, segments: list[Segment], table: str) -> DataFrame:
    """A table of some segments in one scan; but for tombstones, which have one of their own, with the generation of each row from its folder's name."""
    reader = spark.read if table == "gone" else spark.read.option("basePath", f"{path}/segments")
    return reader.parquet(*(f"{path}/segments/{s.name}/{table}" for s in segments))


def _alive(spark: SparkSession, path: str, now: Manifest, rows: DataFrame) -> DataFrame:
    """Rows (doc, gen) without those that a later segment replaced or removed."""
    with_gone = [s for s in now.segments if s.gone]
    return rows.join(_table(spark, path, with_gone, "gone"), ["doc", "gen"], "left_anti") if with_gone else rows


def live_docs(spark: SparkSession, path: str) -> DataFrame:
    """(doc, mtime, doc_type, dl, gen): the documents of an index."""
    now = manifest(spark, path)
    return _alive(spark, path, now, _table(spark, path, now.segments, "docs"))


def update(spark: SparkSession, path: str, corpus: DataFrame, removed: DataFrame | None = None, doc: str = "doc_id", mtime: str = "mtime", content: str = "content", doc_type: str = "doc_type", file_path: str | None = None) -> Manifest:
    """Brings an index, or a new one, up to a corpus: documents that it lacks, or has with an older mtime, go into a delta segment, the others are not read further than their key; `removed` (doc) are removed. Where nothing changed, nothing is written.

    With `file_path`, the tokens of path and fingerprint count as well.
    """
    now = manifest(spark, path)
    cols = [F.col(doc).alias("doc"), F.coalesce(F.col(mtime), F.lit(0)).alias("mtime"), F.col(doc_type).alias("doc_type"), F.col(content).alias("content"), *([F.col(file_path).alias("path")] if file_path else [])]
    came = corpus.where(F.col(doc).isNotNull()).select(*cols)
    gen = max((s.gen for s in now.segments), default=0) + 1
    if now.segments:
        known = live_docs(spark, path).select("doc", F.col("mtime").alias("known"), F.col("gen").alias("was"))
        came = came.join(known, "doc", "left").where("known IS NULL OR mtime > known")
    else:
        came = came.withColumn("was", F.lit(None).cast("int"))
    newest = came.groupBy("doc").agg(F.max_by(F.struct(*[c for c in came.columns if c != "doc"]), F.struct("mtime", F.coalesce("content", F.lit("")))).alias("row")).select("doc", "row.*")
    terms = counted(terms_of(F.col("content"), F.col("path") if file_path else None))
    stage = newest.select("doc", "mtime", "doc_type", "was", terms.alias("terms"))
    stage = stage.select("*", F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + t["tf"]).alias("dl"))
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    stage.write.parquet(staged)
    stage = spark.read.schema(stage.schema).parquet(staged)
    gone = stage.where("was IS NOT NULL").select("doc", F.col("was").alias("gen"))
    if removed is not None and now.segments:
        left = live_docs(spark, path).select("doc", "gen").join(removed.select(F.col(removed.columns[0]).alias("doc")).distinct(), "doc", "left_semi")
        gone = gone.unionByName(left).distinct()
    posting = stage.select("doc", "dl", F.explode("terms").alias("t")).select("t.term", "doc", "t.tf", "dl")
    segment = _write(spark, path, gen, stage.select("doc", "mtime", "doc_type", "dl"), posting, gone)
    _delete(spark, staged)
    if not segment.docs and not segment.gone and now.segments:
        return now
    lost_docs, lost_tokens = 0, 0
    if segment.gone:
        lost = _table(spark, path, now.segments, "docs").join(_table(spark, path, [segment], "gone"), ["doc", "gen"], "left_semi")
        lost_docs, lost_tokens = lost.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return _commit(spark, path, Manifest(now.version + 1, [*now.segments, segment], now.docs - lost_docs + segment.docs, now.tokens - lost_tokens + segment.tokens))


def merge(spark: SparkSession, path: str, most: int) -> Manifest:
    """Rewrites the segments of at most `most` postings as one, without what was replaced or removed since; larger ones stay as they are."""
    now = manifest(spark, path)
    small = [s for s in now.segments if s.postings <= most]
    if len(small) < 2 and not (small and any(s.gone for s in now.segments)):
        return now
    rest = [s for s in now.segments if s not in small]
    gen = max(s.gen for s in now.segments) + 1
    docs = _alive(spark, path, now, _table(spark, path, small, "docs")).drop("gen")
    posting = _alive(spark, path, now, _table(spark, path, small, "postings")).drop("gen")
    others = [s.gen for s in rest]
    gone = _table(spark, path, small, "gone").where(F.col("gen").isin(others) if others else F.lit(False)).distinct()
    segment = _write(spark, path, gen, docs, posting, gone)
    return _commit(spark, path, Manifest(now.version + 1, [*rest, segment], now.docs, now.tokens))


def _delete(spark: SparkSession, path: str) -> None:
    fs, where, _ = _fs(spark, path)
    fs.delete(where, True)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes segments and manifests that the newest manifest does not need; readers of older ones must have ended. Returns the number of segments deleted."""
    now = manifest(spark, path)
    fs, where, _ = _fs(spark, f"{path}/segments")
    kept = {s.name for s in now.segments}
    found = [s.getPath() for gen in fs.listStatus(where) for s in fs.listStatus(gen.getPath())] if fs.exists(where) else []
    old = [n for n in (f"{s.getParent().getName()}/{s.getName()}" for s in found) if n not in kept]
    for name in old:
        _delete(spark, f"{path}/segments/{name}")
    fs, where, _ = _fs(spark, f"{path}/manifests")
    for s in fs.listStatus(where):
        if s.getPath().getName() < f"{now.version:012d}.json":
            fs.delete(s.getPath(), False)
    return len(old)


def lists(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """(term, doc, tf, dl): the postings of terms (term). Up to PUSHED_TERMS terms become a filter of the scan, which skips row groups and pages without them; more are joined."""
    now = manifest(spark, path)
    rows = _table(spark, path, now.segments, "postings")
    few = [r[0] for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    if len(few) <= PUSHED_TERMS:
        any_of = reduce(lambda a, b: a | b, [F.col("term") == t for t in sorted(few)], F.lit(False)) if few else F.lit(False)
        rows = rows.where(any_of)
    else:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return _alive(spark, path, now, rows).select("term", "doc", "tf", "dl")


def bm25(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(q, doc, score, rank): the k best documents of each query (q, term), from the lists of its terms alone; the totals are of the documents that have terms."""
    now = manifest(spark, path)
    terms = written(queries.select("q", "term").distinct(), "asked")
    n = _with_terms(spark, path) if now.docs else 0
    if not n:
        return ranked(terms.where("false").select("q", F.lit(None).cast("long").alias("doc"), F.lit(0.0).alias("score")), k)
    hit = lists(spark, path, terms)
    df = written(hit.groupBy("term").agg(F.count("*").alias("df")), "df")
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(now.tokens / n)))
    s = hit.join(df, "term").select("term", "doc", (idf * tf).alias("s"))
    return best(s, terms.withColumn("w", F.lit(1.0)), df, k)


def _with_terms(spark: SparkSession, path: str) -> int:
    """How many live documents have terms; others count in no statistic of a search."""
    return live_docs(spark, path).where("dl > 0").count()


def tfidf(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(q, doc, score, rank) by cosine. The norm of a document is over all its terms and every term's idf changes with the corpus, so norms are summed anew."""
    now = manifest(spark, path)
    terms = written(queries.select("q", "term").distinct(), "asked")
    if not now.docs:
        return ranked(terms.where("false").select("q", F.lit(None).cast("long").alias("doc"), F.lit(0.0).alias("score")), k)
    post = _alive(spark, path, now, _table(spark, path, now.segments, "postings")).select("term", "doc", "tf")
    df = written(post.groupBy("term").agg(F.count("*").alias("df")), "df")
    return by_cosine(post, df, terms, F.lit(_with_terms(spark, path)), k)


def status(spark: SparkSession, path: str) -> DataFrame:
    """(doc_type, n, tokens) of live documents."""
    return live_docs(spark, path).groupBy("doc_type").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"))
