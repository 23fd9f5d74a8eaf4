"""Output caps and the read ledger: which calls may be capped, in which arm, keys of reads, sizes of responses. Inputs and responses are JSON text, as in a log; the marker by which a caller asks for the whole is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

MARKER, SEED, HOLDOUT = "tracewell:full", "tracewell-v1", 10


def variant_at(json: Column, path: str = "$") -> Column:
    return F.try_variant_get(F.try_parse_json(json), path, "variant")


def kind_of(value: Column) -> Column:
    """STRING, BIGINT, OBJECT<...> and so on; null for nothing."""
    return F.schema_of_variant(value)


def is_truthy(value: Column) -> Column:
    """Whether a JSON value is there and neither false, zero, empty nor null."""
    return F.coalesce(~F.to_json(value).isin("false", "0", "0.0", "-0", '""', "null", "[]", "{}"), F.lit(False))


def cap_refusal(tool: Column, tool_input: Column, marker: str = MARKER) -> Column:
    """Why a call's output may not be capped; null for one whose may."""
    top, command = variant_at(tool_input), variant_at(tool_input, "$.command")
    text = F.when(F.startswith(kind_of(command), F.lit("STRING")), F.try_variant_get(F.try_parse_json(tool_input), "$.command", "string"))
    return (
        F.when(~tool.eqNullSafe(F.lit("Bash")), "not the Bash tool")
        .when(~F.coalesce(F.startswith(kind_of(top), F.lit("OBJECT")), F.lit(False)), "no tool input")
        .when(F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")) == "", "no command")
        .when(is_truthy(variant_at(tool_input, "$.run_in_background")), "background command")
        .when(F.contains(text, F.lit(marker)), "the caller asked for the full output")
        .when(F.regexp_like(text, F.lit(r"\btrap\b")), "the command sets its own trap")
    )


def is_forced(tool_input: Column, marker: str = MARKER) -> Column:
    """Whether one of an input's strings holds the marker, in whatever case; nested values are not looked at."""
    values = F.map_values(F.from_json(tool_input, "map<string,variant>"))
    held = lambda v: F.startswith(F.schema_of_variant(v), F.lit("STRING")) & F.contains(F.lower(v.cast("string")), F.lit(marker))
    return F.coalesce(F.exists(values, held), F.lit(False))


def cap_arm(session: Column, command: Column, percent: int = HOLDOUT, seed: str = SEED) -> Column:
    """(bucket, arm) of a command: the same at any time."""
    b = T.bucket(F.lit(seed), session, F.lit("cap"), command)
    return F.struct(b.alias("bucket"), F.when(b < percent, "held-out").otherwise("cap").alias("arm"))


def holdout_percent(raw: str | None, default: int = HOLDOUT) -> tuple[int, str]:
    """A setting's percentage, and why it is not used if it is not: neither a whole number nor from 0 to 100."""
    said = (raw or "").strip()
    if not said:
        return default, ""
    try:
        percent = int(said.rstrip("%"))
    except ValueError:
        return default, f"{raw!r} is not a whole number; using {default}"
    return (percent, "") if 0 <= percent <= 100 else (default, f"{raw!r} is not a percentage; using {default}")


def read_key(path: Column, offset: Column, limit: Column) -> Column:
    """A read's key: its resolved path, and the range if there is one. Another range is another key."""
    at, of = F.coalesce(offset, F.lit(0)).cast("string"), F.coalesce(limit, F.lit(0)).cast("string")
    return F.concat(F.lower(F.coalesce(path, F.lit(""))), F.when((at != "0") | (of != "0"), F.concat(F.lit("\x1f"), at, F.lit("-"), of)).otherwise(""))


def ledger_id(session: Column, agent: Column) -> Column:
    """The ledger of a conversation; an agent below a session has one of its own."""
    sid = F.when(F.coalesce(session, F.lit("")) == "", "x").otherwise(session)
    return F.when(F.coalesce(agent, F.lit("")) == "", sid).otherwise(F.concat(sid, F.lit(".agent-"), agent))


def response_tokens(response: Column) -> Column:
    """Tokens of a response: a text, an object's file, content, stdout and text (or the content of each), or the texts of a list."""
    v, kind = F.try_parse_json(response), kind_of(F.try_parse_json(response))
    string = lambda path: F.when(F.startswith(kind_of(F.try_variant_get(v, path, "variant")), F.lit("STRING")), F.try_variant_get(v, path, "string"))
    of_object = F.concat(*[F.coalesce(string(f"$.{k}"), string(f"$.{k}.content"), F.lit("")) for k in ("file", "content", "stdout", "text")])
    texts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.try_variant_get(x, "$.text", "string")), F.lit("")))
    text = F.when(F.startswith(kind, F.lit("STRING")), string("$")).when(F.startswith(kind, F.lit("OBJECT")), of_object).when(F.startswith(kind, F.lit("ARRAY")), F.array_join(texts, "")).otherwise("")
    return T.tokens_from_chars(F.length(F.coalesce(text, F.lit(""))), "code")
