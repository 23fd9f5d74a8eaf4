"""Many needles in many texts without comparing all pairs: literal needles, keywords with word borders, globs.

Every needle has a core, a literal piece that each text with it holds. A core is looked up by the one of its grams of four characters (a shorter core is a gram itself) that the fewest texts have, and what is found is confirmed on the whole text. Texts are cut into grams once, only those that some core has are kept before anything is shuffled, and grams carry a 64-bit hash of the text, not the text: equal hashes of different texts only add candidates.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written

GRAM = 4
#: Keywords of at most so many characters match whole words only.
SHORT = 4
#: Keywords of at most so many characters are looked up as they are; files whose marks share a number; characters of prompts that a task cuts.
WHOLE, MARKS, TASK_CHARS = 12, 64, 1 << 19
#: What is not literal in a glob: closed sets, stars and question marks.
WILD = r"\[!?\]?[^\]]*\]|[*?]"


def grams(text: Column, k: Column | int) -> Column:
    """The pieces of k characters of a text; the text itself where it is shorter."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda i: F.substring(text, i, k))


def looked_up(texts: DataFrame, needles: DataFrame, confirm: Callable[[DataFrame], DataFrame], by: list[str]) -> DataFrame:
    """(by, text, needle) of the candidates that `confirm` leaves. texts: by, text, each once and not null; needles: by, needle, core, each needle once; a needle with an empty core is tried on every text of its group."""
    size = F.least(F.length("core"), F.lit(GRAM))
    want = written(needles.select(*by, "needle", F.explode(F.array_distinct(grams(F.col("core"), size))).alias("gram")), "grams")
    sizes = [r[0] for r in want.select(F.length("gram")).distinct().collect()]  # 0 to 4
    if not sizes:
        return confirm(texts.crossJoin(needles.select("needle")).where("false").select(*by, "text", "needle") if not by else texts.join(needles.select(*by, "needle"), by).where("false"))
    keyed = texts.withColumn("tid", F.xxhash64("text"))
    cut = F.array_distinct(F.flatten(F.array(*[grams(F.col("text"), k) if k else F.array(F.lit("")) for k in sorted(sizes)])))
    have = keyed.select(*by, "tid", F.explode(cut).alias("gram")).join(want.select(*by, "gram").distinct(), [*by, "gram"], "left_semi")
    have = written(have.distinct(), "postings")
    counts = have.groupBy(*by, "gram").agg(F.count("*").alias("n"))
    rare = want.join(counts, [*by, "gram"], "left").groupBy(*by, "needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = rare.join(have, [*by, "gram"]).select(*by, "needle", "tid")
    return confirm(found.join(keyed, [*by, "tid"]).select(*by, "text", "needle"))


def contained(texts: DataFrame, needles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, text, needle): texts that contain a needle, within rows of equal `by` where given. Empty and null needles are in none."""
    by = by or []
    t = texts.select(*by, "text").where("text IS NOT NULL").distinct()
    n = needles.select(*by, "needle").where("length(needle) > 0").distinct().withColumn("core", F.col("needle"))
    return looked_up(t, n, lambda c: c.where(F.contains("text", F.col("needle"))), by)


def keyword_hits(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(text, keyword): keywords (keyword) in texts (text). Of at most four characters, they have to be whole words."""
    t = texts.select("text").where("text IS NOT NULL").distinct()
    n = keywords.select(F.col("keyword").alias("needle")).where("length(needle) > 0").distinct().withColumn("core", F.col("needle"))
    return looked_up(t, n, lambda c: c.where(T.keyword_matches(F.col("needle"), F.col("text"))), []).withColumnRenamed("needle", "keyword")


def whole_words(texts: DataFrame) -> DataFrame:
    """(tid, keyword) of texts (tid, text): the pieces of at most SHORT characters between two word borders."""
    cut = texts.select("tid", F.split("text", r"\b").alias("cut"), F.regexp_like("text", F.lit(r"\A\b")).cast("int").alias("led"))
    # no border ends what follows the last one, and none may begin what comes before the first
    parts = cut.select("tid", F.slice("cut", 2 - F.col("led"), F.greatest(F.size("cut") - 2 + F.col("led"), F.lit(0))).alias("parts")).where(F.size("parts") > 0)
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, k), ""))
    words = F.array_distinct(F.filter(F.flatten(F.array(*[runs(k) for k in range(1, SHORT + 1)])), lambda w: F.length(w).between(1, SHORT)))
    return parts.select("tid", F.explode(words).alias("keyword"))


def numbered(prompts: DataFrame) -> DataFrame:
    """(tid, prompt): each prompt once, with a number of its own."""
    return written(prompts.select("prompt").where("prompt IS NOT NULL").distinct().withColumn("tid", F.monotonically_increasing_id()), "prompts")


def files_of(prompts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(tid, file), each once: files one of whose keywords is in a prompt, in any case. prompts: tid, prompt (as `numbered` gives them); keywords: file, keyword.

    Prompts meet keywords, of which there may be very many, by equality: a prompt gives its whole words of at most SHORT characters and its pieces of each other length that a keyword has, so no candidate is wrong and no text moves with one. Longer keywords than WHOLE are looked up by their rarest piece. The files of a keyword are bits of numbers, MARKS files to a number, so that a prompt's hits are one number each and not a row for each file.
    """
    spark = prompts.sparkSession
    words = keywords.select("file", F.lower("keyword").alias("keyword")).where("length(keyword) > 0")
    files = words.select("file").distinct().withColumn("id", F.monotonically_increasing_id())
    files = written(files.select("file", F.floor(F.col("id") / MARKS).alias("bucket"), F.expr(f"shiftleft(1L, CAST(id % {MARKS} AS INT))").alias("mark")), "files")
    known = files.withColumnRenamed("file", "of")
    marks = written(words.join(known, F.col("file").eqNullSafe(F.col("of"))).groupBy("keyword", "bucket").agg(F.bit_or("mark").alias("marks")), "marks")
    sizes = sorted(r[0] for r in marks.select(F.least(F.length("keyword"), F.lit(WHOLE + 1))).distinct().collect())  # 1 to WHOLE + 1

    chars = prompts.agg(F.sum(F.length("prompt"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, min(20_000, chars // TASK_CHARS))
    texts = prompts.select("tid", F.lower("prompt").alias("text")).repartition(tasks, "tid")
    pieces = [whole_words(texts)] if sizes and sizes[0] <= SHORT else []
    if inner := [n for n in sizes if SHORT < n <= WHOLE]:
        each = texts.select("tid", "text", F.explode(F.array(*map(F.lit, inner))).alias("n")).where("length(text) >= n")
        pieces.append(each.select("tid", F.explode(F.array_distinct(grams(F.col("text"), F.col("n")))).alias("keyword")))
    if sizes and sizes[-1] > WHOLE:
        long = keyword_hits(texts, marks.where(F.length("keyword") > WHOLE).select("keyword").distinct())
        pieces.append(long.join(texts, "text").select("tid", "keyword"))
    if not pieces:
        return prompts.select("tid").join(files.select("file")).where("false")
    hits = reduce(DataFrame.unionByName, pieces).join(marks.hint("shuffle_hash"), "keyword")
    found = hits.groupBy("tid", "bucket").agg(F.bit_or("marks").alias("marks"))
    return found.join(files, "bucket").where(F.col("marks").bitwiseAND(F.col("mark")) != 0).select("tid", "file")


def activated(prompts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(prompt, file): files one of whose keywords is in a prompt, in any case. prompts: prompt; keywords: file, keyword."""
    texts = numbered(prompts)
    return files_of(texts, keywords).join(texts, "tid").select("prompt", "file")


def longest_literal(glob: Column) -> Column:
    """The longest piece of a glob between its wild cards; '' if there is none."""
    return F.element_at(F.array_sort(F.split(glob, WILD), lambda a, b: F.length(a) - F.length(b)), -1)


def glob_pattern(glob: Column) -> Column:
    """A regular expression for a glob without sets."""
    tokens = F.regexp_extract_all(glob, F.lit(r"(\*+|\?|[^*?]+)"), F.lit(1))
    each = lambda x: F.when(F.startswith(x, F.lit("*")), ".*").when(x == "?", ".").otherwise(F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(tokens, each), ""), F.lit(r"\z"))


def glob_hits(texts: DataFrame, globs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, text, glob): texts that a glob fits as a whole: * for any characters, slashes too, ? for one, [..] and [!..] for one of a set; case counts. Only candidates with a set are looked at in Python."""
    by = by or []
    t = texts.select(*by, "text").where("text IS NOT NULL").distinct()
    n = globs.select(*by, F.col("glob").alias("needle")).where("needle IS NOT NULL").distinct().withColumn("core", longest_literal(F.col("needle")))

    def fits(text: pd.Series, glob: pd.Series) -> pd.Series:
        return pd.Series([fnmatch.fnmatchcase(t, g) for t, g in zip(text, glob, strict=True)], dtype=bool)

    def fit(c: DataFrame) -> DataFrame:
        # ranges and negations of sets are not what regular expressions of the JVM make of them
        fits_set = F.pandas_udf(fits, "boolean")
        plain = c.where(~F.contains("needle", F.lit("["))).where(F.regexp_like("text", glob_pattern(F.col("needle"))))
        return plain.unionByName(c.where(F.contains("needle", F.lit("["))).where(fits_set("text", "needle")))

    return looked_up(t, n, fit, by).withColumnRenamed("needle", "glob")


def name_of(path: Column) -> Column:
    """The last part of a path, whatever slashes end it."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def read_files(paths: DataFrame, reads: DataFrame, globs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, path): paths that were read: by name, or by a glob that fits the path, or whose last part fits the path's last part.

    paths and reads: by, path; globs: by, glob.
    """
    by = by or []
    p = paths.select(*by, "path").where("path IS NOT NULL").distinct()
    exact = p.join(reads.select(*by, "path").distinct(), [*by, "path"], "left_semi")
    whole = glob_hits(p.select(*by, F.col("path").alias("text")), globs, by).select(*by, F.col("text").alias("path"))
    named = p.withColumn("text", name_of(F.col("path")))
    last = glob_hits(named, globs.select(*by, name_of(F.col("glob")).alias("glob")), by).select(*by, "text").distinct()
    return exact.unionByName(whole).unionByName(named.join(last, [*by, "text"]).select(*by, "path")).distinct()


def unread_edits(calls: DataFrame, session: str = "session_id", order: str = "pos") -> DataFrame:
    """Edits of files that no read and no glob of the session before them covers.

    calls: session, order, tool (Read, Glob, Edit), path (of a Glob its pattern).
    """
    edits = calls.where("tool = 'Edit'").select(session, order, "path")
    seen = calls.where("tool = 'Read'").select(session, F.col("path"), F.col(order).alias("at"))
    searched = calls.where("tool = 'Glob'").groupBy(session, F.col("path").alias("glob")).agg(F.min(order).alias("at"))
    p = edits.select(session, F.col("path").alias("text")).distinct()
    whole = glob_hits(p, searched, [session]).join(searched, [session, "glob"]).select(session, F.col("text").alias("path"), "at")
    names = edits.select(session, "path", name_of(F.col("path")).alias("text")).distinct()
    last = searched.select(session, name_of(F.col("glob")).alias("glob"), "at").groupBy(session, "glob").agg(F.min("at").alias("at"))
    by_name = glob_hits(names, last, [session]).join(last, [session, "glob"]).join(names, [session, "text"]).select(session, "path", "at")
    first = seen.unionByName(whole).unionByName(by_name).groupBy(session, "path").agg(F.min("at").alias("at"))
    return edits.join(first, [session, "path"], "left").where(F.col("at").isNull() | (F.col("at") >= F.col(order))).select(session, order, "path")
