"""Queries that run as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tail
from ..sources.shared import shared_dir
from ..streaming import monitors as S
from ..streaming import registry as R
from ..streaming import sessions as N
from ..streaming import witness as W
from .monitors import LED
from .registry import query
from .views import TABLES, VIEWS, ctes, view

TOTAL = "(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens)"


def records(spark, d):
    """The usage view over a stream of events."""
    return spark.sql(TABLES.sub(lambda m: "{" + m[1] + "}", VIEWS["usage"]), events=S.stream_of(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_sliding_usage", ctes("usage") + f", h AS (SELECT project, date_trunc('hour', ts) AS hr, sum({TOTAL}) AS t, count(*) AS n FROM usage GROUP BY 1, 2), w AS (SELECT project, hr - to_hours(CAST(o AS INTEGER)) AS start, t, n FROM h, range(5) r(o)) SELECT CAST(epoch_us(start) // 1000000 AS BIGINT) AS start_s, project, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) AS api_calls FROM w GROUP BY 1, 2")
def stream_sliding_usage(spark, d):
    s = S.run_once(S.sliding_usage(records(spark, d)), "complete")
    return s.select(F.unix_seconds("start").alias("start_s"), "project", "tokens", "api_calls")


@query("stream_daily_usage", ctes("usage") + f" SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum({TOTAL}) AS BIGINT) AS tokens FROM usage GROUP BY 1")
def stream_daily_usage(spark, d):
    return S.run_once(S.daily_usage(records(spark, d)), "complete").select(F.to_date("day").cast("string").alias("day"), "tokens")


@query("stream_distinct_requests", ctes("usage") + " SELECT model, count(*) AS n FROM usage GROUP BY model")
def stream_distinct_requests(spark, d):
    r = records(spark, d)
    twice = r.unionByName(r)
    return S.run_once(S.distinct_requests(twice, "40 days")).groupBy("model").agg(F.count("*").alias("n"))


@query("stream_read_decisions", ctes("accesses") + f", {LED} SELECT pos, CASE WHEN n % 2 = 0 AND prior >= 400 THEN 'NOTICE' ELSE 'ALLOW' END AS action, CASE WHEN n % 2 = 0 AND prior >= 400 THEN greatest(0, prior - 40) ELSE 0 END AS saved_tokens_est FROM rd")
def stream_read_decisions(spark, d):
    """The ledger of redundant reads with keyed state: the same rows as its window form."""
    a = spark.sql(TABLES.sub(lambda m: "{" + m[1] + "}", VIEWS["accesses"]), events=S.stream_of(spark, d, "events"))
    return S.run_once(S.ledger_decisions(ledger_events(a), expire=False)).select("pos", "action", "saved_tokens_est")


def ledger_events(a):
    return a.selectExpr("CAST(user_id % 10 AS STRING) AS ledger", "pos", "CASE WHEN tool = 'Compact' AND pos % 20 = 0 THEN 'compact' WHEN tool = 'Compact' THEN 'other' WHEN tool = 'Edit' THEN 'edit' ELSE 'read' END AS event", "path", "k % 2 AS range", "CAST(floor(extract(day FROM ts) / 8) AS INT) AS stat", "k * 12 AS tokens")


@query("monitor_ledger_fold", ctes("accesses") + f", {LED} SELECT pos, CASE WHEN n % 2 = 0 AND prior >= 400 THEN 'NOTICE' ELSE 'ALLOW' END AS action, CASE WHEN n % 2 = 0 AND prior >= 400 THEN greatest(0, prior - 40) ELSE 0 END AS saved_tokens_est FROM rd")
def monitor_ledger_fold(spark, d):
    """The ledger as a registered monitor in batch."""
    return R.in_batch(R.LEDGER, ledger_events(view(spark, d, "accesses"))).select("pos", "action", "saved_tokens_est")


@query("stream_log_tail", "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY event_type")
def stream_log_tail(spark, d):
    """Events written as logs of JSON lines, taken as a stream of byte spans over many triggers."""
    logs = f"{shared_dir(spark)}/logs/{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{d}/events.parquet")
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    events.repartitionByRange(8, "event_id").select(line).write.option("lineSep", "\n").text(logs)
    tail.register(spark)
    lines = spark.readStream.format("tail").options(path=logs, glob="part-*.txt", firstLook="all", maxBytes=str(256 << 10)).load()
    rows = S.run_once(lines.select(F.from_json("line", "event_id long, user_id long, event_type string").alias("e")).select("e.*"), idle=True)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


HOOKS = "hk AS (SELECT CAST(user_id % 40 AS STRING) AS session_id, event_id AS hook, ts FROM {events} WHERE event_type = 'signup' AND event_id % 3 <> 0)"
MARKS = "mk AS (SELECT CAST(user_id % 40 AS STRING) AS session_id, event_id AS marker, ts FROM {events} WHERE event_type = 'signup' UNION ALL SELECT CAST(user_id % 40 AS STRING), event_id, ts FROM {events} WHERE event_type = 'signup' AND event_id % 5 = 0)"
WITNESS = "WITH " + HOOKS.format(events="events") + ", " + MARKS.format(events="events") + ", m AS (SELECT session_id, marker, min(ts) AS ts FROM mk GROUP BY 1, 2), j AS (SELECT m.session_id, m.marker, m.ts, count(hook) = 0 AS missed FROM m LEFT JOIN hk h ON h.session_id = m.session_id AND h.ts BETWEEN m.ts - INTERVAL 5 MINUTE AND m.ts + INTERVAL 5 MINUTE GROUP BY 1, 2, 3) SELECT session_id, marker, missed, CAST(sum(CASE WHEN missed THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, marker ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM j"


def told(spark, events):
    """The hooks that fired and the markers of all compactions, some of them twice."""
    return tuple(spark.sql(f"WITH {cte} SELECT * FROM {name}", events=events).withColumn("ts", F.col("ts").cast("timestamp")) for name, cte in (("hk", HOOKS), ("mk", MARKS)))


@query("monitor_missed_compactions", WITNESS)
def monitor_missed_compactions(spark, d):
    """Compactions by their markers, and those that no hook told of."""
    return W.counted(W.unwitnessed(*told(spark, spark.read.parquet(f"{d}/events.parquet")))).select("session_id", "marker", "missed", "so_far")


@query("stream_missed_compactions", WITNESS)
def stream_missed_compactions(spark, d):
    """The same by an outer join of two streams; a last hook and marker, far behind all others, bring the watermarks to the end."""
    events = spark.read.parquet(f"{d}/events.parquet")
    end = f"{shared_dir(spark)}/ends/{uuid.uuid4().hex}/events.parquet"
    last = events.agg(*[F.max(c).alias(c) for c in events.columns]).where("ts IS NOT NULL").withColumn("event_type", F.lit("signup")).withColumn("event_id", F.lit(-1).cast(events.schema["event_id"].dataType))
    days = F.expr("INTERVAL 30 DAYS")
    last.select(*[(F.col(c) + days).cast(events.schema[c].dataType).alias(c) if c == "ts" else F.col(c).cast(events.schema[c].dataType).alias(c) for c in events.columns]).write.parquet(end)
    both = S.stream_of(spark, d, "events").unionByName(S.stream_of(spark, end.rsplit("/", 1)[0], "events"))
    found = S.run_once(W.witnessed(*told(spark, both)))
    return W.missed(found.where("marker >= 0")).select("session_id", "marker", "missed", "so_far")


EVENTS = """se AS (SELECT 's' || CAST(user_id % 30 AS STRING) AS session_id, pos, CASE WHEN tool = 'Edit' THEN 'edit' WHEN tool = 'Read' THEN 'read' WHEN tool = 'Compact' THEN CASE k % 9 WHEN 0 THEN 'precompact' WHEN 1 THEN 'marker' WHEN 2 THEN 'start' ELSE 'stop' END WHEN tool = 'Bash' THEN CASE k % 11 WHEN 0 THEN 'commit' WHEN 1 THEN 'note' ELSE 'stop' END WHEN k % 2 = 0 THEN 'output' ELSE 'stop' END AS event,
  path, CAST(k % 2 AS STRING) AS range, CASE WHEN tool = 'Error' THEN k * 100 ELSE k * 12 END AS tokens, CASE WHEN tool = 'Compact' THEN k * 40 + 3000 ELSE k * 50 END AS context FROM {accesses})"""
# all sessions a step at a time; reads give a void here, their decisions are tested by loops
MESSAGES = """ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS n FROM se),
st(session_id, n, pos, win, edits, commits, noted, alerted, since, pending, comp, kind, value) AS (SELECT DISTINCT session_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, -1::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[], '', 0::BIGINT FROM ev
  UNION ALL SELECT session_id, n, pos, CASE WHEN event = 'precompact' THEN win + 1 ELSE win END, CASE WHEN event = 'edit' THEN edits + 1 ELSE edits END, CASE WHEN event = 'commit' THEN commits + 1 ELSE commits END, CASE WHEN event = 'note' THEN win ELSE noted END, CASE WHEN alert THEN win ELSE alerted END,
    CASE WHEN event = 'start' THEN 25 WHEN event = 'stop' AND nudge THEN 0 WHEN event = 'stop' THEN since + 1 ELSE since END, CASE WHEN event = 'marker' THEN pending + 1 WHEN event = 'read' THEN 0 ELSE pending END, CASE WHEN event = 'precompact' THEN list_append(comp, context)[-8:] ELSE comp END,
    CASE WHEN alert THEN 'alert' WHEN nudge THEN 'nudge' WHEN event = 'start' THEN 'handback' WHEN event = 'read' AND pending > 0 THEN 'void' WHEN event = 'output' AND tokens > 6000 THEN 'cap' ELSE '' END, CASE WHEN alert THEN context WHEN nudge THEN edits WHEN event = 'start' THEN win WHEN event = 'read' THEN pending ELSE 4240 END
  FROM (SELECT *, NOT alert AND event = 'stop' AND noted <> win AND (edits >= 6 OR commits > 0) AND since + 1 >= 25 AS nudge FROM (SELECT s.session_id, e.n, e.pos, win, edits, commits, noted, alerted, since, pending, comp, event, context, tokens, event = 'stop' AND len(comp) > 0 AND context > 0 AND context >= CAST(floor(list_min(comp) * 0.8::DOUBLE) AS BIGINT) AND alerted <> win AS alert FROM st s JOIN ev e ON e.session_id = s.session_id AND e.n = s.n + 1)))"""
SESSION_SQL = ctes("accesses").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + EVENTS.format(accesses="accesses") + f", {MESSAGES} SELECT session_id, pos, kind, value FROM st WHERE kind <> ''"
READS = ["allow", "notice", "deny", "held"]


def session_events(spark, accesses):
    return spark.sql("WITH " + EVENTS.replace("{accesses}", "{a}") + " SELECT * FROM se", a=accesses)


@query("monitor_session_messages", SESSION_SQL)
def monitor_session_messages(spark, d):
    """What a session's events call for beside the decisions on its reads: alerts, nudges, hand-backs, voids and caps."""
    return N.messages(session_events(spark, view(spark, d, "accesses"))).where(~F.col("kind").isin(READS))


@query("stream_session_messages", SESSION_SQL)
def stream_session_messages(spark, d):
    """The same as a stream."""
    a = spark.sql(TABLES.sub(lambda m: "{" + m[1] + "}", VIEWS["accesses"]), events=S.stream_of(spark, d, "events"))
    return S.run_once(N.message_stream(session_events(spark, a), expire=False)).where(~F.col("kind").isin(READS))


def loop_calls(a):
    return a.selectExpr("CAST(user_id AS STRING) AS session_id", "pos", "pos AS turn", "CASE WHEN tool IN ('Edit', 'Bash') THEN 'm' || (k % 3) END AS file", "CASE WHEN tool IN ('Edit', 'Bash') THEN tool || '|' || (k % 3) END AS signature")


@query("monitor_loop_stages")
def monitor_loop_stages(spark, d):
    """The stages of loops by session in batch; tests compare them with the stream."""
    return R.in_batch(R.LOOPS, loop_calls(view(spark, d, "accesses")))


@query("stream_loop_stages")
def stream_loop_stages(spark, d):
    """The same as a stream."""
    a = spark.sql(TABLES.sub(lambda m: "{" + m[1] + "}", VIEWS["accesses"]), events=S.stream_of(spark, d, "events"))
    return S.run_once(R.as_stream(R.LOOPS, loop_calls(a)))


@query("monitor_early_compactions", ctes("accesses") + ", w AS (SELECT user_id, pos, tool, CAST(sum(k * 50) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS t FROM accesses) SELECT user_id, CAST(sum(CASE WHEN t < 12000 * 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS early, CAST(sum(CASE WHEN t >= 12000 * 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS at_wall, min(t) AS least FROM w WHERE tool = 'Compact' GROUP BY user_id")
def monitor_early_compactions(spark, d):
    """Compactions before and at 80 percent of a context's limit, and the least context that was compacted."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("pos").rowsBetween(-3, 0)
    c = view(spark, d, "accesses").withColumn("t", F.sum(F.col("k") * 50).over(w)).where("tool = 'Compact'")
    wall = F.col("t") >= 12000 * 0.8
    return c.groupBy("user_id").agg(F.sum((~wall).cast("int")).alias("early"), F.sum(wall.cast("int")).alias("at_wall"), F.min("t").alias("least"))


@query("usage_prices_by_name", ctes("usage") + ", m AS (SELECT DISTINCT model FROM usage), p(name, price, n) AS (VALUES ('opus-4-6', 5.0::DOUBLE, 1), ('x-sonnet', 3.0::DOUBLE, 2), ('y-haiku-4', 1.0::DOUBLE, 3)), e AS (SELECT model, price FROM m JOIN p ON name = model), f AS (SELECT model, arg_min(price, n) AS price FROM m JOIN p ON contains(model, string_split(name, '-')[2]) WHERE model NOT IN (SELECT model FROM e) GROUP BY model) SELECT model, price FROM e UNION ALL SELECT model, price FROM f")
def usage_prices_by_name(spark, d):
    """A model's price by its name, else by the second part of a known name; the first known one wins. The price table is fixed."""
    p = spark.createDataFrame([("opus-4-6", 5.0, 1), ("x-sonnet", 3.0, 2), ("y-haiku-4", 1.0, 3)], "name string, price double, n int")
    m = view(spark, d, "usage").select("model").distinct()
    exact = m.join(F.broadcast(p), F.col("name") == F.col("model")).select("model", "price")
    near = m.join(exact.select("model"), "model", "left_anti").join(F.broadcast(p), F.contains("model", F.element_at(F.split("name", "-"), 2)))
    return exact.unionByName(near.groupBy("model").agg(F.min_by("price", "n").alias("price")))
