"""Benchmark decontamination with a distributed positional inverted index. DataFrame operations only.

The index has a posting (term, document, position) for training tokens. Counted first are the postings of each test term; each phrase of the benchmark then takes its two rarest terms, and only these terms' postings are stored.
A phrase's rarest list is intersected with the other one at the adjusted offset. Of the documents that this leaves, the words in the places that candidates cover are postings too: a candidate is an exact match if all of its phrase's terms stand at their offsets. No row holds more than a word, whatever the length of a text, but for the reading of the text itself.
With slop, the two lists are also met within a distance, in bins of positions: proximity matches.

Words are the runs of 0-9, a-z and everything beyond ASCII, after A-Z are lower-cased. A phrase is each window of `width` words of an item, or the whole of a shorter item.

Very long texts are read whole. Nulls: a null text has no words; a null item_id takes part in hits but is not named among the items. Items without words are left out. Rows with the same id and text have the same result, rows with the same id and other texts each their own. An empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, size_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A table of test terms goes to every executor up to this size of its file; beyond it, postings are shuffled to it by term.
BROADCAST_BYTES = 16 << 20


def cut(text: Column) -> Column:
    """The words of a text in their own case; the first or the last may be empty, where the text begins or ends between words."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else; the translation, slow, is left to the few words beyond ASCII that need it."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word)


def words(text: Column) -> Column:
    return F.transform(F.filter(cut(text), lambda w: w != ""), lowered)


def phrases(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(phrase, n, items): the distinct word windows of all items; phrase is an array of words."""
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    windows = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, F.lit(width)).alias("phrase"))
    return windows.groupBy("phrase").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("phrase"))


def small(table: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast if its size on disk is within bounds."""
    return F.broadcast(table) if size_of(table) <= BROADCAST_BYTES else table


def tokens(docs: DataFrame) -> DataFrame:
    """(doc, key, pos, term): every word of every document; an empty word before or after the text keeps its place and matches nothing."""
    return docs.select("doc", "key", F.posexplode(cut(F.col("text"))).alias("pos", "raw")).select("doc", "key", "pos", lowered(F.col("raw")).alias("term"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc, key, n_words): every document."""
    held = docs.select("doc", "key", cut(F.col("text")).alias("w"))
    edges = (F.element_at("w", 1) == "").cast("long") + ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("long")
    return held.select("doc", "key", (F.size("w").cast("long") - edges).alias("n_words"))


def phrase_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits, per document): exact occurrences of benchmark phrases, and every document with its number of words.

    hits: doc, key, start, n, items. With slop > 0 also near matches, where the two rarest terms of a phrase lie up to slop words off their distance; those have exact = false.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    per_doc = word_counts(docs)
    phrase = saved(phrases(benchmark, width).withColumn("pid", F.xxhash64("phrase")), "phrases")
    terms = saved(phrase.select(F.explode("phrase").alias("term")).distinct(), "terms")
    # with a large benchmark each word is counted before it is sent anywhere
    of_terms = tokens(docs).join(F.broadcast(terms), "term") if size_of(terms) <= BROADCAST_BYTES else tokens(docs)
    counts = saved(of_terms.groupBy("term").agg(F.count("*").alias("df")).join(terms, "term"), "df")

    # each phrase's terms by rarity; a term that occurs nowhere makes its phrase one that occurs nowhere
    ranked = phrase.select("pid", "n", F.posexplode("phrase").alias("off", "term")).join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = ranked.groupBy("pid").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "off", "term"))), 1, 2).alias("rare")).where("rare[0].df > 0")
    plan = ranked.join(phrase, "pid").select("pid", "phrase", "items", "n", F.col("rare")[0].alias("first"), F.try_element_at("rare", F.lit(2)).alias("second"))
    plan = saved(plan.select("pid", "phrase", "items", "n", F.col("first.term").alias("term"), F.col("first.off").alias("off"), F.col("second.term").alias("term2"), F.col("second.off").alias("off2")), "plan")
    wanted = saved(plan.select(F.explode(F.array("term", "term2")).alias("term")).where("term IS NOT NULL").distinct(), "wanted")
    lists = saved(tokens(docs).join(small(wanted), "term"), "postings")

    one = lists.join(small(plan), "term").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0").select("doc", "key", "start", "pid", "n", "term2", "off2", "items")
    meant = one.where("term2 IS NOT NULL").withColumn("at", F.col("start") + F.col("off2"))
    same_doc = lambda a, b: a["doc"].eqNullSafe(b["doc"]) & (a["key"] == b["key"])
    both = meant.join(lists, same_doc(meant, lists) & (meant["at"] == lists["pos"]) & (meant["term2"] == lists["term"]), "left_semi").select("doc", "key", "start", "pid", "n")
    single = one.where("term2 IS NULL").select("doc", "key", "start", "pid", "n")
    candidates = saved(both.unionByName(single).distinct(), "candidates")  # a repeated row has its postings twice

    # the words at the places of candidates, of the documents that have some
    some = small(saved(candidates.select("doc", "key").distinct(), "some"))
    again = docs.join(some, same_doc(docs, some), "left_semi")
    words_of = plan.select("pid", F.posexplode("phrase").alias("k", "term"))
    asked = candidates.select("doc", "key", "start", "pid").join(words_of, "pid").select("doc", "key", "start", "pid", (F.col("start") + F.col("k")).alias("pos"), "term")
    there = tokens(again)
    stands = asked.join(there, same_doc(asked, there) & (asked["pos"] == there["pos"]) & (asked["term"] == there["term"]), "left_semi")
    matched = stands.groupBy("doc", "key", "start", "pid").agg(F.count("*").alias("m"))
    exact = matched.join(plan.select("pid", "n", "items"), "pid").where("m = n").select("doc", "key", "start", "n", "items", F.lit(True).alias("exact"))
    if not slop:
        return exact, per_doc
    exact = saved(exact, "exact")
    other = lists.select(F.col("doc").alias("doc2"), F.col("key").alias("key2"), F.col("pos").alias("pos2"), F.col("term").alias("term2"))
    bin_ = 2 * width + slop
    left = meant.withColumn("bin", F.explode(F.array_distinct(F.array(F.floor((F.col("at") - slop) / bin_), F.floor((F.col("at") + slop) / bin_)))))
    right = other.withColumn("bin", F.floor(F.col("pos2") / bin_))
    near = left.join(right, left["doc"].eqNullSafe(right["doc2"]) & (F.col("key") == F.col("key2")) & (left["term2"] == right["term2"]) & (left["bin"] == right["bin"]) & (F.abs(F.col("pos2") - F.col("at")) <= slop))
    near = near.select("doc", "key", "start", "n", "items", F.lit(False).alias("exact")).distinct()
    return exact.unionByName(near.join(exact.select("doc", "key", "start", "n"), ["doc", "key", "start", "n"], "left_anti")), per_doc


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, and key, the hash of its text."""
    hits, per_doc = phrase_hits(docs, benchmark, width, id_col=id_col, text_col=text_col)
    hits = saved(hits, "hits")
    none = F.sha2(F.lit(""), 256)
    covered = hits.select("doc", "key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct().groupBy("doc", "key").agg(F.count("*").alias("n_hit"))
    named = hits.select("doc", "key", F.explode("items").alias("item")).distinct().groupBy("doc", "key").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ","), 256).alias("items_sha256"))
    hit = covered.join(named, (covered["doc"].eqNullSafe(named["doc"])) & (covered["key"] == named["key"]), "left").select(covered["doc"].alias("d"), covered["key"].alias("k"), "n_hit", "n_items", "items_sha256")
    out = per_doc.join(hit, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("doc").alias(id_col), "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "key")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key")


#: Exact on whole tables: 10-word windows as joined strings.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS g, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
