"""Sources and sinks of append-only JSON logs. Schemas are explicit; lines that do not parse are counted, not fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "struct<type: string, id: string, name: string, input: string, tool_use_id: string, content: string, text: string>"
TRANSCRIPT = (
    "type string, timestamp string, requestId string, sessionId string, cwd string, gitBranch string, isCompactSummary boolean, compactMetadata string,"
    " message struct<id: string, model: string, role: string, content: string, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint,"
    " cache_creation: struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>>>, _corrupt string"
)
EVENT = "v int, ts double, component string, event string, session_id string, agent_id string, arm string, acting boolean, team string, tokens bigint, chars bigint, path string, _corrupt string"
TURN = "turn_id string, timestamp string, project string, session_id string, prompt_length int, was_notification boolean, injection_chars bigint, hot_count int, warm_count int, files_injected array<string>, files_used array<string>, waste_ratio double"
HISTORY = "turn int, timestamp string, instance_id string, prompt_keywords array<string>, activated array<string>, hot array<string>, warm array<string>, cold_count int, transitions struct<to_hot: array<string>, to_warm: array<string>, to_cold: array<string>>, total_chars bigint"
STATS = "dailyModelTokens array<struct<date: string, tokensByModel: map<string, bigint>>>, modelUsage map<string, struct<inputTokens: bigint, outputTokens: bigint, cacheReadInputTokens: bigint, cacheCreationInputTokens: bigint>>"


def read_log(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A log of JSON lines; _corrupt holds what did not parse where the schema has it."""
    r = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return r.options(**options).json(path)


def parsed_time(text: Column) -> Column:
    """ISO times; without a zone they are UTC (the session's zone), what does not parse is null."""
    return F.try_to_timestamp(F.when(F.trim(text) == "", None).otherwise(text))


def usage_records(lines: DataFrame, project: Column | None = None) -> DataFrame:
    """Usage records of a transcript's assistant lines that carry usage. Without the parts of cache creation they are 0; a total of 0 is the sum of its parts."""
    u = F.col("message.usage")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    m5, h1 = zero(u["cache_creation"]["ephemeral_5m_input_tokens"]), zero(u["cache_creation"]["ephemeral_1h_input_tokens"])
    total = zero(u["cache_creation_input_tokens"])
    r = lines.where((F.col("type") == "assistant") & u.isNotNull())
    return r.select(
        parsed_time(F.col("timestamp")).alias("ts"),
        F.coalesce("requestId", F.lit("")).alias("request_id"),
        F.col("sessionId").alias("session_id"),
        (project if project is not None else project_of(F.col("cwd"))).alias("project"),
        F.col("gitBranch").alias("git_branch"),
        F.coalesce("message.model", F.lit("unknown")).alias("model"),
        zero(u["input_tokens"]).alias("input_tokens"),
        zero(u["output_tokens"]).alias("output_tokens"),
        m5.alias("cache_creation_5m_tokens"),
        h1.alias("cache_creation_1h_tokens"),
        F.when(total == 0, m5 + h1).otherwise(total).alias("cache_creation_tokens"),
        zero(u["cache_read_input_tokens"]).alias("cache_read_tokens"),
    )


def project_of(cwd: Column, home: str = "/home/") -> Column:
    """The first folder under a home, else the last folder."""
    under = F.regexp_extract(cwd, rf"^{home}[^/]+/([^/]+)", 1)
    return F.when(F.coalesce(cwd, F.lit("")) == "", "~").when(under != "", under).otherwise(F.element_at(F.split(F.regexp_replace(cwd, "/+$", ""), "/"), -1))


def blocks(lines: DataFrame) -> DataFrame:
    """One row for each content block: content is a list of blocks or a plain text, which becomes a text block."""
    c = F.col("message.content")
    listed = F.from_json(c, f"array<{BLOCK}>")
    one = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), c.alias("text"))), BLOCK))
    return lines.withColumn("_b", F.when(F.startswith(F.ltrim(c), F.lit("[")), listed).otherwise(one)).select("*", F.posexplode("_b").alias("block_no", "block")).drop("_b")


def block_text(content: Column) -> Column:
    """The text of a result that is a text, a list of {text} or an object with one."""
    listed = F.array_join(F.transform(F.from_json(content, "array<struct<text: string>>"), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), listed).when(F.startswith(F.ltrim(content), F.lit("{")), F.coalesce(F.get_json_object(content, "$.text"), content)).otherwise(content)


def assembled_turns(rows: DataFrame, session: str = "session_id", order: str = "pos") -> DataFrame:
    """Adds turn: how many user rows there were up to and with the row."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("turn", F.sum((F.col("role") == "user").cast("int")).over(w))


def good_events(events: DataFrame, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(events of the version, one row with how many lines were torn or of another version)."""
    torn = F.col("_corrupt").isNotNull()
    counts = events.agg(F.sum(torn.cast("int")).alias("torn"), F.sum((~torn & ~F.col("v").eqNullSafe(version)).cast("int")).alias("foreign_version"))
    return events.where(~torn & F.col("v").eqNullSafe(version)).drop("_corrupt"), counts


def daily_model_tokens(stats: DataFrame) -> DataFrame:
    return stats.select(F.explode("dailyModelTokens").alias("d")).select(F.col("d.date").alias("date"), F.explode("d.tokensByModel").alias("model", "tokens"))


def commits_of(text: DataFrame, marker: str = "COMMIT") -> DataFrame:
    """(commit_idx, path) from a git log whose commits begin with a marker line; one row of text for each repository."""
    parts = F.filter(F.split(F.col("value"), rf"(?m)^{marker}[^\n]*\n?"), lambda x: F.trim(x) != "")
    return text.select(F.posexplode(parts).alias("commit_idx", "files")).select("commit_idx", F.explode(F.split("files", "\n")).alias("path")).where("trim(path) <> ''").select("commit_idx", F.trim("path").alias("path"))


# Extensions of files that a commit is learned from.
LEARNED = ["py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "c", "cpp", "h", "rb"]


def is_learned(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)).isin(LEARNED)


def described_commits(text: DataFrame, marker: str = "---MSG---", least: int = 10, most: int = 20) -> DataFrame:
    """(repo, commit_idx, prompt, files) from git logs (repo, value; one row for each repository) whose commits begin with a marker line, have a line with the subject and then the files. The first line of ten characters or more is the subject; of the files the first twenty source files count, and a commit without both is none."""
    lines = F.transform(F.split("block", "\n"), lambda x: F.trim(x))
    blocks = text.select("repo", F.posexplode(F.slice(F.split("value", rf"(?m)^{marker}[^\n]*\n?"), 2, 1 << 30)).alias("commit_idx", "block")).withColumn("lines", lines)
    at = F.array_position(F.transform("lines", lambda x: F.length(x) >= least), True).cast("int")
    found = blocks.withColumn("at", at).where("at > 0")
    files = F.slice(F.filter(F.slice("lines", F.col("at") + 1, F.size("lines")), lambda x: is_learned(x)), 1, most)
    return found.select("repo", "commit_idx", F.element_at("lines", F.col("at")).alias("prompt"), files.alias("files")).where(F.size("files") > 0)


def pushed_commits(pushes: DataFrame, rows: int = 200_000, shortest: int = 10, longest: int = 500, most: int = 20) -> DataFrame:
    """(repo_name, commit_message, changed_files, file_count): the newest commits of an event archive (repo_name, created_at, commits of message, is_distinct and files) with a message of usual length and up to twenty different source files."""
    c = pushes.select("repo_name", "created_at", F.explode("commits").alias("c")).where(F.col("c.is_distinct") & F.length("c.message").between(shortest, longest))
    files = F.array_distinct(F.filter("c.files", lambda f: f.isNotNull() & F.regexp_like(f, F.lit(r"\.(" + "|".join(LEARNED) + ")$"))))
    kept = c.select("repo_name", "created_at", F.col("c.message").alias("commit_message"), F.array_sort(files).alias("changed_files")).withColumn("file_count", F.size("changed_files")).where(F.col("file_count").between(1, most))
    return kept.orderBy(F.desc("created_at"), "repo_name", "commit_message").limit(rows).drop("created_at")


def newer(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files that an index lacks or has older."""
    return files.join(indexed.select("path", F.col("mtime").alias("_m")), "path", "left").where("_m IS NULL OR mtime > _m").drop("_m")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest n rows of a log, for its retention."""
    return df.orderBy(F.desc(order)).limit(n)


def export(df: DataFrame, path: str, kind: str) -> None:
    """CSV with quotes where needed, or JSON lines; other kinds are refused."""
    if kind == "csv":
        df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no export of kind {kind!r}")
