"""Spelling variants: a symmetric-delete join. Every word emits itself and its distinct single deletions; words that share a key and differ by exactly one code point are near; a word's form is the most frequent of them, and forms are followed to their root.

1. Words are counted: runs of letters, cut with `split`, are counted before they are shuffled, so a word that is a third of all is a few rows.
2. Each word emits a row for itself and one for each distinct string that a deletion leaves, with the positions (a run of equal letters) whose deletion leaves it.
3. Two words that share a deletion differ by exactly one replaced code point if the deletion is at the same position in both. All words with the same (deletion, position) are near to each other, so their links are counted, and the most frequent is found, within the group: no pairs are listed. Such a group is no larger than the alphabet (90 letters), whatever the vocabulary.
4. A word that equals a deletion of another is one inserted or deleted code point away; as the deletions of a word are distinct, the equi-join finds each such link once.
5. Counts of links are summed, the best of all groups is the best near word. A form has at least `ratio` times the word's occurrences, so forms make no circles; pointers are doubled by joins until nothing changes, each round written to the shared folder.

No pair of words is met twice: a replaced pair has one position, an inserted pair one deletion.
Nulls: a null text has no words, a null id counts as ''. Empty texts and tables give no words. Very long texts are cut within one row. Rows that repeat count each. Only the id and text columns are read, whatever other columns are called. Ties of occurrences are broken by code-point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

#: Fixed values of the query: the letters, and what deletes a letter of a run (crc32 of "<doc_id>:<run>" divided by this).
NO_LETTERS, MISSPELL = r"[^A-Za-zÀ-ÿ]+", 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rounds of doubled pointers; a chain of forms has no more than 63 links, for each doubles its occurrences.
ROUNDS = 8


def without(word: Column, at: Column) -> Column:
    """The word without the code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspell: int = 0) -> DataFrame:
    """(word, n): all runs of letters, A-Z lower-cased. With `misspell`, each run of which it divides the crc32 (after the row's id and a colon) lacks the letter at crc32 % length, which plants variants that can be told."""
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.split(F.col(text_col), NO_LETTERS)).alias("w"))
    own = own.where("w <> ''").withColumn("w", F.translate("w", UPPER, LOWER))
    if misspell:
        own = own.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "w").cast("binary")))
        own = own.withColumn("w", F.when(F.col("h") % misspell == 0, without(F.col("w"), (F.col("h") % F.length("w")).cast("int"))).otherwise(F.col("w")))
    return own.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n"))


def deletions(words: DataFrame) -> DataFrame:
    """(word, n, key, lo, hi): each distinct string that deleting one code point leaves; deleting any of lo .. hi leaves it."""
    letter = lambda k: F.substring("word", k + 1, F.lit(1))
    starts = F.filter(F.sequence(F.lit(0), F.length("word") - 1), lambda k: (k == 0) | (letter(k) != letter(k - 1)))
    each = words.where("word <> ''").withColumn("_starts", starts).select("word", "n", "_starts", F.posexplode("_starts").alias("_k", "lo"))
    hi = F.coalesce(F.get("_starts", F.col("_k") + 1), F.length("word")) - 1
    return each.select("word", "n", without(F.col("word"), F.col("lo")).alias("key"), "lo", hi.alias("hi"))


def best(n: str, word: str) -> Column:
    """Orders the most frequent first, then by code points."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best: (less, word)) for each word that has a near one; words: word, n, each word once."""
    gone = saved(deletions(words), "deletions")
    # replaced: the same deletion at the same position
    placed = gone.select("word", "key", F.explode(F.sequence("lo", "hi")).alias("at"), best("n", "word").alias("own"))
    group = Window.partitionBy("key", "at")
    first = group.orderBy("own")
    placed = placed.withColumn("m", F.count("*").over(group)).withColumn("k", F.row_number().over(first)).where("m > 1")
    placed = placed.withColumn("top", F.min("own").over(group)).withColumn("next", F.min(F.when(F.col("k") == 2, F.col("own"))).over(group))
    replaced = placed.select("word", (F.col("m") - 1).alias("links"), F.when(F.col("k") == 1, F.col("next")).otherwise(F.col("top")).alias("other"))
    # inserted or deleted: a deletion that is a word
    met = gone.select("word", "key", best("n", "word").alias("long")).join(words.select(F.col("word").alias("key"), best("n", "word").alias("short")), "key")
    shorter = met.select("word", F.lit(1).alias("links"), F.col("short").alias("other"))
    longer = met.select(F.col("key").alias("word"), F.lit(1).alias("links"), F.col("long").alias("other"))
    return replaced.unionByName(shorter).unionByName(longer).groupBy("word").agg(F.sum("links").cast("long").alias("n_near"), F.min("other").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): each word followed to the last form. A word without one is its own root."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        step = now.alias("a").join(now.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        after = saved(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return now
    raise RuntimeError("forms have no end")


def variants(counts: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of every word of at least so many code points and occurrences. counts: word, n."""
    words = saved(counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count)).select("word", "n"), "words")
    near = saved(words.join(near_words(words), "word", "left"), "near")
    form = (-F.col("best.less")) >= F.col("n") * ratio
    out = near.select("word", "n", F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    return out.join(roots(out.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(occurrences(docs, misspell=MISSPELL)).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = """
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS r FROM documents),
each AS (SELECT i, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs GROUP BY i, w),
bytes AS (SELECT w, n, hex(encode(i || ':' || w)) AS x FROM each),
-- crc32, four bits at a time: the second digit of a byte, then the first
digits AS (SELECT w, n, list_transform(range(1, length(x) + 1), lambda k: CAST(instr('0123456789ABCDEF', substr(x, k + CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END, 1)) - 1 AS BIGINT)) AS d FROM bytes),
crc AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), d), lambda c, b: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, b) & 15) + 1])), 4294967295) AS h FROM digits),
corpus AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n FROM crc GROUP BY 1),
words AS MATERIALIZED (SELECT word, n FROM corpus WHERE length(word) >= 5 AND n >= 3),
gone AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
links AS (SELECT a.word, b.word AS other, b.n FROM gone a JOIN gone b ON a.key = b.key AND a.k = b.k AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.key = w.word
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.key = w.word),
near AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS other, max(n) AS other_n FROM links GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, CASE WHEN other_n >= 2 * w.n THEN other END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS root, form AS further FROM forms UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN forms f ON walk.further = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN walk ON f.word = walk.word AND walk.further IS NULL
"""
