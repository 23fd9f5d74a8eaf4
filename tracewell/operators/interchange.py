"""Exchange with other tools: observations of files in use, their field names, a ledger of learned facts, handoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .needles import contained

# Our names of an observation's fields, and theirs.
FIELDS = {"id": "id", "session_id": "session_id", "timestamp": "timestamp", "tool_name": "tool", "observation_type": "type", "concepts": "concepts", "raw_tokens": "raw_tokens", "compressed_tokens": "compressed_tokens", "semantic_summary": "summary", "key_facts": "facts", "related_files": "files"}
# What stands for a field that is not there.
DEFAULTS = {"id": "''", "session_id": "'unknown'", "timestamp": "CAST(NULL AS STRING)", "tool_name": "'unknown'", "observation_type": "'info'", "concepts": "CAST(array() AS array<string>)", "raw_tokens": "0L", "compressed_tokens": "0L", "semantic_summary": "''", "key_facts": "CAST(array() AS array<string>)", "related_files": "CAST(array() AS array<string>)"}
WARM, STRONG, TOGETHER = 0.25, 0.5, 0.3


def to_foreign(observations: DataFrame) -> DataFrame:
    return observations.select(*[(F.col(ours) if ours in observations.columns else F.expr(DEFAULTS[ours])).alias(theirs) for ours, theirs in FIELDS.items()])


def from_foreign(observations: DataFrame) -> DataFrame:
    return observations.select(*[(F.col(theirs) if theirs in observations.columns else F.expr(DEFAULTS[ours])).alias(ours) for ours, theirs in FIELDS.items()])


def of_files_in_use(observations: DataFrame, scores: DataFrame) -> DataFrame:
    """Observations (id, related_files) with a file whose stem is in the path of one that is at least warm; a path that is equal or an end contains the stem as well."""
    rel = observations.select("id", F.explode("related_files").alias("f")).select("id", T.stem(F.col("f")).alias("needle")).distinct()
    hit = contained(scores.where(F.col("score") >= WARM).select(F.col("path").alias("text")), rel).select("needle").distinct()
    return observations.join(rel.join(hit, "needle").select("id").distinct(), "id", "left_semi")


def ledger_rows(affinities: DataFrame, edges: DataFrame, discoveries: DataFrame, source: str = "tracewell") -> DataFrame:
    """(type, content, metadata) of strong affinities (word, path, affinity), edges (src, dst, weight) and discoveries (description, path)."""
    meta = lambda **kv: F.create_map(F.lit("source"), F.lit(source), *[x for k, c in kv.items() for x in (F.lit(k), c.cast("string"))])
    row = lambda df, kind, content, m: df.select(F.lit(kind).alias("type"), content.alias("content"), m.alias("metadata"))
    a = row(affinities.where(F.col("affinity") > STRONG), "observation", F.format_string("Learned association: '%s' → %s (score: %.2f)", "word", "path", "affinity"), meta(word=F.col("word"), file=F.col("path"), score=F.col("affinity")))
    e = row(edges.where(F.col("weight") > TOGETHER), "observation", F.format_string("Co-activation pattern: %s ↔ %s (score: %.2f)", "src", "dst", "weight"), meta(file1=F.col("src"), file2=F.col("dst"), score=F.col("weight")))
    d = row(discoveries, "discovery", F.coalesce("description", F.lit("")), meta(file=F.coalesce("path", F.lit(""))))
    return a.unionByName(e).unionByName(d)


def learned_from_ledger(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ledger_rows gives, taken back: affinities, edges, discoveries. Which one a row is, its metadata tells; a score that is missing is the least that was exported."""
    m = lambda k: F.col("metadata")[k]
    seen = F.col("type") == "observation"
    word = seen & m("word").isNotNull() & m("file").isNotNull()
    pair = seen & ~word & m("file1").isNotNull() & m("file2").isNotNull()
    score = lambda least: F.coalesce(m("score").cast("double"), F.lit(least))
    return (
        rows.where(word).select(m("word").alias("word"), m("file").alias("path"), score(STRONG).alias("affinity")),
        rows.where(pair).select(m("file1").alias("src"), m("file2").alias("dst"), score(TOGETHER).alias("weight")),
        rows.where("type = 'discovery'").select(F.col("content").alias("description"), F.coalesce(m("file"), F.lit("")).alias("path")),
    )


def handoff(summary: Column, decisions: Column, next_steps: Column, source: str = "tracewell") -> Column:
    """A session's row for the next one."""
    return F.struct(F.lit("handoff").alias("type"), summary.alias("content"), F.struct(F.lit(source).alias("source"), decisions.alias("decisions"), next_steps.alias("next_steps")).alias("metadata"))


def merged(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Learned values of two systems, of both the higher."""
    return ours.select(*keys, value).unionByName(theirs.select(*keys, value)).groupBy(*keys).agg(F.max(value).alias(value))


def save_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def load_ledger(spark, path: str) -> DataFrame:
    return spark.read.schema("type string, content string, metadata map<string, string>").json(path)
