"""Batch twins of the stream operators, over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.plans.registry import query
from folio.sources.tables import table
from folio.streaming import events as ev
from folio.streaming import stateful as st


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


_NUMBERED = "e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(f"""WITH RECURSIVE {_NUMBERED},
r AS (SELECT event_id, user_id, n, 0::BIGINT AS in_window, true AS accepted, list_value(us) AS taken FROM e WHERE n = 1
UNION ALL SELECT event_id, user_id, n, len(held)::BIGINT, len(held) < 3, CASE WHEN len(held) < 3 THEN list_append(held, us) ELSE held END
FROM (SELECT e.*, list_filter(r.taken, lambda t: t > e.us - 604800000000) AS held FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT event_id, user_id, in_window, accepted FROM r""")
def sliding_rate_limit(spark, sf_dir):
    """At most three accepted events of a user in a week before each; refused ones do not count."""
    return ev.accepted(events(spark, sf_dir), 3, 7 * 86_400)


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS attempts FROM events")
def sliding_attempts(spark, sf_dir):
    """All events of a user in the day that ends with each, refused or not."""
    return ev.attempts(events(spark, sf_dir), 86_400).select("event_id", "user_id", F.col("in_window").alias("attempts"))


@query(f"""WITH RECURSIVE {_NUMBERED},
r AS (SELECT event_id, user_id, n, us, true AS accepted, 1.0::DOUBLE AS left_over FROM e WHERE n = 1
UNION ALL SELECT event_id, user_id, n, us, have >= 1, CASE WHEN have >= 1 THEN have - 1 ELSE have END
FROM (SELECT e.*, least(2.0, r.left_over + (e.us - r.us) / 1000000.0::DOUBLE * 0.000003::DOUBLE) AS have FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT event_id, user_id, accepted FROM r""")
def token_bucket(spark, sf_dir):
    """Two tokens for each user, of which one comes back in about four days."""
    return ev.taken_tokens(events(spark, sf_dir), 2.0, 0.000003)


@query("""WITH s AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS step,
 (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id, date_trunc('day', ts))) / 1000000.0 AS elapsed FROM events)
SELECT event_id, step::INT AS step, step < 15 AND elapsed < 600 AS goes_on FROM s""")
def session_limits(spark, sf_dir):
    """A user's day is a session, which ends at 15 steps or after ten minutes."""
    rows = events(spark, sf_dir).withColumn("session", F.date_trunc("day", "ts"))
    return ev.bounded(rows).select("event_id", "step", "goes_on")


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'interaction' WHEN event_type = 'error' THEN 'failure' ELSE 'other' END AS kind,
 CASE WHEN event_type IN ('click', 'view') THEN json_extract(props, '$.k')::BIGINT ELSE -1 END AS target, CASE WHEN event_type = 'error' THEN round(value, 2) ELSE -1 END AS code FROM events""")
def typed_event_log(spark, sf_dir):
    """The session log: each event carries the fields of its own type alone."""
    return ev.typed(events(spark, sf_dir)).fillna(-1)


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n, round(sum(value), 4) AS tokens FROM events GROUP BY 1, 2")
def tumbling_window_counts(spark, sf_dir):
    return ev.tumbling(events(spark, sf_dir), "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n", F.round("tokens", 4).alias("tokens"))


@query("SELECT strftime(b - INTERVAL (k * 15) MINUTE, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, event_type, unnest([0, 1, 2, 3]) AS k FROM events) GROUP BY 1, 2")
def ext_sliding_window(spark, sf_dir):
    return ev.sliding(events(spark, sf_dir)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("""WITH s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS new FROM events))
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, nth""")
def ext_session_window(spark, sf_dir):
    return ev.sessions(events(spark, sf_dir), "6 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


@query("""SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM events GROUP BY user_id""")
def session_metrics(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"))


@query("SELECT event_id, user_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before IS NULL OR value > before")
def monotonic_progress(spark, sf_dir):
    return ev.progress(events(spark, sf_dir)).select("event_id", "user_id")


@query("""WITH s AS (SELECT *, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)
SELECT event_id, user_id, (s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS open FROM s""")
def running_gauge(spark, sf_dir):
    return ev.gauge(events(spark, sf_dir)).select("event_id", "user_id", "open")


@query("""WITH c AS (SELECT user_id, max((ts, event_id)) AS cut FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT e.user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text FROM events e LEFT JOIN c USING (user_id) WHERE cut IS NULL OR (ts, event_id) > cut GROUP BY e.user_id""")
def delta_gate(spark, sf_dir):
    return ev.final_text(events(spark, sf_dir))


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, ts, event_id")
def message_idempotency(spark, sf_dir):
    """The first delivery of a message; user and type stand for its key."""
    g = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("x"))
    return g.select("user_id", "event_type", "x.event_id")


_TWO_DAYS = 172_800


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, (1 + floor(value / 10))::BIGINT AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, us AS first, cost <= 12 AS accepted, (cost <= 12)::INT AS k, CASE WHEN cost <= 12 THEN cost ELSE 0 END AS used FROM e WHERE n = 1
UNION ALL SELECT event_id, user_id, n, first, fits, k + fits::INT, used + CASE WHEN fits THEN cost ELSE 0 END
FROM (SELECT *, k + 1 <= 3 AND used + cost <= 12 AS fits FROM (SELECT e.event_id, e.user_id, e.n, e.cost, CASE WHEN over THEN e.us ELSE r.first END AS first, CASE WHEN over THEN 0 ELSE r.k END AS k, CASE WHEN over THEN 0 ELSE r.used END AS used
FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, LATERAL (SELECT e.us - r.first >= {_TWO_DAYS}000000 AS over))))
SELECT event_id, user_id, first AS begin, accepted FROM r""")
def request_windows(spark, sf_dir):
    """Windows of two days that begin with a user's first request, each with budgets of requests and tokens."""
    cost = (1 + F.floor(F.col("value") / 10)).cast("long")
    return st.budgeted(events(spark, sf_dir).withColumn("cost", cost), 3, 12, _TWO_DAYS)


@query("""WITH k AS (SELECT *, CASE event_type WHEN 'error' THEN 'tool' WHEN 'purchase' THEN 'final' ELSE 'part' END AS kind FROM events),
r AS (SELECT *, coalesce(sum((kind <> 'part')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k)
SELECT max(event_id) FILTER (kind = 'final') AS event_id, user_id, string_agg(event_type || ' ', '' ORDER BY ts, event_id) FILTER (kind = 'part') AS text FROM r GROUP BY user_id, run HAVING count(*) FILTER (kind = 'final') > 0 AND count(*) FILTER (kind = 'part') > 0""")
def gated_answers(spark, sf_dir):
    """Answers of a user: what was said since the last tool call (an error here) or answer, put out by its end (a purchase)."""
    kind = F.when(F.col("event_type") == "error", st.TOOL).when(F.col("event_type") == "purchase", st.FINAL).otherwise(st.PART)
    return st.gated(events(spark, sf_dir).withColumn("kind", kind).withColumn("text", F.concat("event_type", F.lit(" "))))
