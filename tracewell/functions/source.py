"""Column functions over source files and pages of notes: summaries, keywords, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .code import all_of
from .text import stem


def summary_line(text: Column) -> Column:
    """The first comment or docstring of the first ten lines, up to 100 characters."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), lambda x: F.trim(x))
    said = F.transform(lines, lambda x: F.when(F.startswith(x, F.lit('"""')) | F.startswith(x, F.lit("'''")), F.trim(F.regexp_replace(x, "^[\"']+|[\"']+$", ""))).when(F.startswith(x, F.lit("#")) | F.startswith(x, F.lit("//")) | F.startswith(x, F.lit("/*")), F.trim(F.regexp_replace(x, "^[/*#]+", ""))))
    good = F.filter(said, lambda x: x.isNotNull() & (x != "") & ~F.startswith(x, F.lit("!")))
    return F.substring(F.try_element_at(good, F.lit(1)), 1, 100)


def described_files(text: Column) -> Column:
    """Files that a page names in backticks, sorted."""
    return F.array_sort(F.array_distinct(F.concat(all_of(text, r"`([a-zA-Z0-9_/.-]+\.[a-zA-Z]+)`"), all_of(text, r"\*\*Location\*\*:\s*`([^`]+)`"))))


def listed_keywords(text: Column) -> Column:
    line = F.regexp_extract(text, r"## (?:Auto-Generated )?Keywords?\s*\n([^\n#]+)", 1)
    return F.filter(F.split(line, r"[,\s]+"), lambda w: w != "")


def page_keywords(path: Column, text: Column) -> Column:
    """Words of a page's name, folder, headings, bold terms and up to twenty terms in backticks, in order, each once."""
    split = lambda c: F.split(F.translate(F.lower(c), "-_", "  "), r"\s+")
    name = F.filter(split(stem(path)), lambda w: F.length(w) > 2)
    folder = F.filter(F.array(F.lower(F.element_at(F.split(path, "/"), -2))), lambda w: F.length(w) > 2)
    good = lambda ws: F.filter(ws, lambda w: (F.length(w) > 3) & ~w.isin(W.STOP_WORDS))
    head = lambda x: F.when(F.startswith(x, F.lit("#")), good(split(F.trim(F.regexp_replace(x, "^#+", ""))))).otherwise(F.array().cast("array<string>"))
    bold = lambda x: F.flatten(F.transform(all_of(x, r"\*\*([^*]+)\*\*"), lambda b: good(split(b))))
    body = F.flatten(F.transform(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.concat(head(x), bold(x))))
    ticks = F.transform(F.slice(all_of(text, "`([a-zA-Z][a-zA-Z0-9_-]{3,})`"), 1, 20), lambda x: F.lower(x))
    return F.array_distinct(F.concat(name, folder, body, ticks))


def contents(pages: DataFrame, most: int = 2000) -> DataFrame:
    """(path, toc, lines): headings, the two lines behind each, and top points of a page, up to the first that exceeds `most` characters.

    Which lines count depends on the last heading, so lines are numbered within their heading; the budget is a running sum over these.
    """
    lines = pages.select("path", F.posexplode(F.split("content", "\n")).alias("n", "text")).withColumn("s", F.trim("text"))
    w = Window.partitionBy("path").orderBy("n")
    head = F.startswith("s", F.lit("#"))
    lines = lines.withColumn("heads", F.sum(head.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.sum(((F.col("s") != "") & ~head).cast("int")).over(Window.partitionBy("path", "heads").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    point = (F.startswith("s", F.lit("-")) | F.startswith("s", F.lit("*"))) & ~F.startswith("s", F.lit("---"))
    kept = lines.withColumn("nth", nth).where(head | ((F.col("s") != "") & (F.col("nth") <= 2)) | point)
    kept = kept.withColumn("used", F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= most)
    return kept.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("toc"), F.count("*").alias("lines"))


def promotion(note: Column, target: Column, body: Column) -> Column:
    """UNPROMOTED without a target, PROMOTED if the target's text has enough of the note's first twelve words, else CLAIMED."""
    ws = F.filter(F.regexp_extract_all(F.lower(note), F.lit(r"[a-z0-9_./-]{4,}"), F.lit(0)), lambda w: ~w.isin("that", "this", "with", "from", "have", "been", "will", "must"))
    hits = F.size(F.filter(F.slice(ws, 1, 12), lambda w: F.contains(F.lower(body), w)))
    enough = hits >= F.greatest(F.lit(2), F.least(F.lit(3), F.size(ws)))
    return F.when(F.coalesce(target, F.lit("")) == "", "UNPROMOTED").when(body.isNotNull() & (F.size(ws) > 0) & enough, "PROMOTED").otherwise("CLAIMED")


def confidence(injected: Column, used: Column, extra_reads: Column, reads: Column, waste: Column) -> Column:
    """Relevance, sufficiency, precision and their weighed mean, from numbers of a turn."""
    rel = F.when(injected > 0, used / injected).otherwise(1.0)
    suf = F.when(reads > 0, F.greatest(F.lit(0.0), 1.0 - extra_reads / reads)).otherwise(1.0)
    pre = F.when(waste >= 0, 1.0 - waste).otherwise(1.0)
    return F.struct(F.round(rel, 3).alias("relevance"), F.round(suf, 3).alias("sufficiency"), F.round(pre, 3).alias("precision"), F.round(0.4 * rel + 0.3 * suf + 0.3 * pre, 3).alias("composite"))


def project_name(folder: Column) -> Column:
    """The project of an encoded folder: what follows a drive, or a home and its user; ~ for the home itself."""
    rest = F.when(F.contains(folder, F.lit("--")), F.regexp_extract(folder, "--(.*)$", 1)).when(F.startswith(folder, F.lit("-")), F.regexp_replace(folder, "^-+", "")).otherwise(folder)
    seg = F.split(rest, "-")
    home = (F.size(seg) >= 2) & seg[0].isin("Users", "home")
    inner = F.array_join(F.slice(seg, F.lit(3), F.greatest(F.size(seg) - 2, F.lit(0))), "-")
    return F.when(F.coalesce(folder, F.lit("")) == "", "unknown").when(home, F.when(F.size(seg) > 2, inner).otherwise("~")).when(rest != "", rest).otherwise(folder)


def namespace_id(path: Column) -> Column:
    """A readable key of a repository path: the last folder's slug and a digest of the whole."""
    canon = F.lower(F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/+$", ""))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.element_at(F.split(canon, "/"), -1), "[^a-z0-9_-]+", "-"), "^-+|-+$", ""), 1, 24)
    return F.when(F.trim(path) == "", "default-000000000000").otherwise(F.concat(F.when(slug == "", "repo").otherwise(slug), F.lit("-"), F.substring(F.sha2(canon, 256), 1, 12)))


def mentioned_files(prompt: Column) -> Column:
    """Files that a prompt names, addresses of pages left out, sorted."""
    exts = "py js ts tsx jsx rs go java rb cpp c h hpp css html md json yaml yml toml sql txt sh cfg ini xml conf vue swift kt scala".split()
    bare = F.regexp_replace(prompt, r"(?:https?|file)://\S+", " ")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?:[\w./\\-]+/)?[\w.-]+\.(?:" + "|".join(exts) + r")(?![A-Za-z0-9_])"), F.lit(0))))


def hashed_words(prompts: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, slot, weight): words of a prompt hashed to 256 slots, of length 1. The last byte of a digest is the digest modulo 256."""
    w = prompts.select(*key, F.explode(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")).alias("w"))
    n = w.groupBy(*key, F.conv(F.substring(F.md5("w"), 31, 2), 16, 10).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    return n.select(*key, "slot", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*key))), 9).alias("weight"))
