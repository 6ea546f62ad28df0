"""Queries over counts, reports, audits and distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import values as vx
from folio.operators import synthesis as sx
from folio.plans.registry import query
from folio.sources.tables import table

@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS buyers""")
def dashboard_counts(spark, sf_dir):
    count = lambda name, as_: table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias(as_))
    orders = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.countDistinct("o_custkey").alias("buyers"))
    return reduce(lambda a, b: a.crossJoin(b), (count("customer", "customers"), count("lineitem", "lines")), orders)  # one row each


@query("SELECT c_custkey, count(o_orderkey) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def project_workflow_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0)


@query("SELECT t AS type, count(event_id) AS n FROM (SELECT unnest(['click', 'view', 'error', 'refund']) AS t) LEFT JOIN events ON event_type = t GROUP BY t")
def count_by_type_zero_filled(spark, sf_dir):
    kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, ("click", "view", "error", "refund")))).alias("type"))
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


_COST = "(SELECT *, round(value * 0.001, 6) AS cost, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS context FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01')"


def _month_costs(spark, sf_dir, start="2024-01-01"):
    e = table(spark, sf_dir, "events")
    first = F.lit(start).cast("timestamp")
    e = e.where((F.col("ts") >= first) & (F.col("ts") < F.add_months(first, 1).cast("timestamp")))
    return e.select("ts", F.round(F.col("value") * 0.001, 6).alias("cost"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("context"))


@query(f"SELECT '2024-01' AS month, round(coalesce(sum(cost), 0), 4) AS total, count(*) AS calls, round(coalesce(sum(cost), 0) / greatest(1, date_diff('day', DATE '2024-01-01', DATE '2024-01-11')) * day(last_day(DATE '2024-01-01')), 4) AS projected FROM {_COST}")
def monthly_cost_report(spark, sf_dir, start: str = "2024-01-01", now: str = "2024-01-11"):
    """Costs of the month that begins at start, projected to its end from the days gone by; the clock is the caller's."""
    first = F.lit(start).cast("date")
    elapsed, days = F.greatest(F.lit(1), F.datediff(F.lit(now).cast("date"), first)), F.dayofmonth(F.last_day(first))
    rows = _month_costs(spark, sf_dir, start).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("sum"), F.count(F.lit(1)).alias("calls"))
    return rows.select(F.date_format(first, "yyyy-MM").alias("month"), F.round("sum", 4).alias("total"), "calls", F.round(F.col("sum") / elapsed * days, 4).alias("projected"))


@query(f"SELECT 'context' AS dimension, coalesce(context, 'other') AS value, round(sum(cost), 4) AS cost, count(*) AS calls FROM {_COST} GROUP BY 2 UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), round(sum(cost), 4), count(*) FROM {_COST} GROUP BY 2")
def cost_by_dimension(spark, sf_dir):
    rows = _month_costs(spark, sf_dir)
    pairs = F.explode(F.array(F.struct(F.lit("context").alias("d"), F.coalesce("context", F.lit("other")).alias("v")), F.struct(F.lit("day").alias("d"), F.date_format("ts", "yyyy-MM-dd").alias("v")))).alias("k")
    return rows.select(pairs, "cost").groupBy(F.col("k.d").alias("dimension"), F.col("k.v").alias("value")).agg(F.round(F.sum("cost"), 4).alias("cost"), F.count(F.lit(1)).alias("calls"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(100.0 * count(*) FILTER (value > 50) / nullif(count(*) FILTER (value > 10), 0), 1) AS pass_rate FROM events GROUP BY event_type")
def eval_metrics(spark, sf_dir):
    rate = F.try_divide(100.0 * F.count_if(F.col("value") > 50), F.count_if(F.col("value") > 10))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(rate, 1).alias("pass_rate"))


_SCORE = "CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END"


@query(f"SELECT o_orderstatus AS status, count(*) AS total, count(*) FILTER ({_SCORE} = 3) AS high, count(*) FILTER ({_SCORE} = 2) AS medium, count(*) FILTER ({_SCORE} < 2) AS low, round(avg({_SCORE}), 4) AS score FROM orders GROUP BY 1")
def confidence_breakdown(spark, sf_dir):
    s = F.expr(_SCORE)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == 3).alias("high"), F.count_if(s == 2).alias("medium"), F.count_if(s < 2).alias("low"), F.round(F.avg(s), 4).alias("score"))


@query("SELECT count(DISTINCT l_partkey) AS cited, count(DISTINCT l_orderkey) AS reports FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def count_distinct_cited(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return l.join(o, l.l_orderkey == o.o_orderkey).agg(F.countDistinct("l_partkey").alias("cited"), F.countDistinct("l_orderkey").alias("reports"))


@query("SELECT source, sum(n)::BIGINT AS hits FROM (SELECT unnest(['a', 'b', event_type]) AS source, unnest([1, event_id % 3, 2]) AS n FROM events) GROUP BY source")
def source_counts(spark, sf_dir):
    item = lambda s, n: F.struct(s.alias("source"), n.cast("long").alias("n"))
    lists = F.array(item(F.lit("a"), F.lit(1)), item(F.lit("b"), F.col("event_id") % 3), item(F.col("event_type"), F.lit(2)))
    return table(spark, sf_dir, "events").select(F.explode(lists).alias("x")).groupBy("x.source").agg(F.sum("x.n").alias("hits"))


_FLOW = """WITH d AS (SELECT count(*) AS identified FROM documents), l AS (SELECT count(*) AS scored, count(*) FILTER (quality = 0) AS low, count(*) FILTER (toxic = 1) AS rejected FROM labels),
v AS (SELECT count(*) AS in_project FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))"""


@query(_FLOW + """ SELECT identified, least(identified, scored) AS screened, least(least(identified, scored), low) AS excluded, in_project, greatest(0, identified - least(identified, greatest(in_project, least(identified, scored)))) AS duplicates, rejected FROM d, l, v""")
def prisma_flow(spark, sf_dir):
    """Identified, screened and excluded records; counts never exceed what was identified."""
    d = table(spark, sf_dir, "documents")
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    one = d.agg(F.count(F.lit(1)).alias("identified"))
    scored = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("quality") == 0).alias("low"), F.count_if(F.col("toxic") == 1).alias("rejected"))
    kept = d.join(ids, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("in_project"))
    row = one.crossJoin(scored).crossJoin(kept).withColumn("screened", F.least("identified", "scored"))  # one row each
    tracked = F.least("identified", F.greatest("in_project", "screened"))
    return row.select("identified", "screened", F.least("screened", "low").alias("excluded"), "in_project", F.greatest(F.lit(0), F.col("identified") - tracked).alias("duplicates"), "rejected")


@query(_FLOW + """ SELECT stage, label, n FROM (SELECT unnest(['identification', 'screening', 'screening', 'included']) AS stage, unnest(['records', 'scored', 'rejected', 'saved']) AS label, unnest([identified, scored, rejected, in_project]) AS n FROM d, l, v)
UNION ALL SELECT 'sources', source, count(*) FROM documents GROUP BY source""")
def audit_long(spark, sf_dir):
    """The audit as (stage, label, n) rows."""
    d = table(spark, sf_dir, "documents")
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    labels = table(spark, sf_dir, "labels")
    row = lambda stage, label, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), F.lit(label).alias("label"), "n")
    parts = [row("identification", "records", d), row("screening", "scored", labels), row("screening", "rejected", labels.where("toxic = 1")), row("included", "saved", d.join(ids, "doc_id", "left_semi"))]
    by_source = d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.lit("sources").alias("stage"), F.col("source").alias("label"), "n")
    return reduce(lambda a, b: a.unionByName(b), [*parts, by_source])


@query("SELECT o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '-' END AS detail, count(*) AS n FROM orders GROUP BY 1, 2")
def status_buckets(spark, sf_dir):
    detail = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("-")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), detail.alias("detail")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def year_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("SELECT trim(p_brand) AS venue, count(*) AS n FROM part WHERE trim(p_brand) <> '' GROUP BY 1 ORDER BY n DESC, venue LIMIT 5")
def top_venues(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.trim("p_brand").alias("venue")).where("venue <> ''").groupBy("venue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "venue").limit(5)


@query("SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS n FROM orders WHERE o_orderdate::DATE >= (SELECT max(o_orderdate)::DATE - 29 FROM orders) GROUP BY 1")
def timeline_30d(spark, sf_dir):
    """Thirty days up to the last one seen."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    last = days.agg(F.date_sub(F.max("d"), 29).alias("since"))  # one row
    return days.join(F.broadcast(last), F.col("d") >= F.col("since")).select(F.col("d").cast("string").alias("day"), "n")


@query("SELECT l_shipmode AS mode, rate FROM (SELECT l_linestatus AS l_shipmode, round_even(count(*) FILTER (l_returnflag = 'N') / nullif(count(*) FILTER (l_returnflag IN ('N', 'R')), 0)::DOUBLE, 3) AS rate FROM lineitem GROUP BY 1)")
def quality_rates(spark, sf_dir):
    done, decided = F.count_if(F.col("l_returnflag") == "N"), F.count_if(F.col("l_returnflag").isin("N", "R"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("mode")).agg(F.bround(F.try_divide(done.cast("double"), decided), 3).alias("rate"))


_FIELD = "CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END"


@query(f"SELECT brand AS key, count(*) AS n, (SELECT count(*) FROM part) AS total FROM (SELECT {_FIELD} AS brand FROM part) WHERE brand IS NOT NULL AND brand <> '' GROUP BY brand")
def aggregate_field(spark, sf_dir):
    """Counts by value; missing values count in the total alone."""
    p = table(spark, sf_dir, "part").select(F.expr(_FIELD).alias("key"))
    n = p.where(~vx.missing(F.col("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("total"))))


@query(f"SELECT brand || '|' || p_size % 3 AS key, count(*) AS n FROM (SELECT {_FIELD} AS brand, p_size FROM part) WHERE brand IS NOT NULL AND brand <> '' GROUP BY 1")
def aggregate_crosstab(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.expr(_FIELD).alias("v"), (F.col("p_size") % 3).cast("string").alias("g"))
    return p.where(~vx.missing(F.col("v"))).groupBy(F.concat_ws("|", "v", "g").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT field, populated, total, round(populated / total::DOUBLE, 3) AS coverage FROM (SELECT unnest(['brand', 'name', 'type']) AS field, unnest([b, n, t]) AS populated, total FROM (SELECT count(*) FILTER (brand <> '') AS b, count(*) FILTER (p_name <> '') AS n, count(*) FILTER (p_type <> '') AS t, count(*) AS total FROM (SELECT *, {_FIELD} AS brand FROM part)))")
def field_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.expr(_FIELD).alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    counts = p.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(~vx.missing(F.col(c))).alias(c) for c in p.columns))
    return counts.unpivot(["total"], p.columns, "field", "populated").select("field", "populated", "total", F.round(F.try_divide(F.col("populated").cast("double"), F.col("total")), 3).alias("coverage"))


@query("""WITH d AS (SELECT doc_id % 40 AS audit, source, n_chars % 9 - 2 AS result_count FROM documents), v AS (SELECT doc_id % 40 AS audit, source, arg_max(lang, doc_id) AS language FROM documents WHERE doc_id % 3 = 0 AND lang IS NOT NULL GROUP BY 1, 2),
o AS (SELECT audit, bool_or(language <> 'en') AS other FROM (SELECT doc_id % 40 AS audit, lang AS language FROM documents WHERE doc_id % 3 = 0 AND lang IS NOT NULL) GROUP BY audit),
c AS (SELECT d.audit, coalesce(v.language, 'en') AS language, sum(result_count)::BIGINT AS n FROM d LEFT JOIN v ON v.audit = d.audit AND v.source = d.source WHERE result_count > 0 GROUP BY 1, 2)
SELECT a.audit, coalesce(string_agg(language || ':' || n, ',' ORDER BY language), '') AS counts, coalesce(round_even(coalesce(sum(n) FILTER (language = 'en'), 0) / sum(n)::DOUBLE, 2), 0) AS score, coalesce(bool_or(other), false) AS other_languages
FROM (SELECT DISTINCT audit FROM d) a LEFT JOIN c USING (audit) LEFT JOIN o USING (audit) GROUP BY a.audit""")
def language_bias_audit(spark, sf_dir):
    """Searches (a fortieth of the documents each) whose sources were asked in a language of their own, the last one stated."""
    d = table(spark, sf_dir, "documents").withColumn("audit", F.col("doc_id") % 40)
    diagnostics = d.select("audit", "source", (F.col("n_chars") % 9 - 2).alias("result_count"))
    variants = d.where("doc_id % 3 = 0 AND lang IS NOT NULL").select("audit", "source", F.col("lang").alias("language"), F.col("doc_id").alias("place"))
    a = sx.language_audit(diagnostics, variants, "audit")
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return a.select("audit", counts.alias("counts"), "score", "other_languages")


_PERCENTS = (0.1, 0.25, 0.5, 0.75, 0.9)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, " + ", ".join(f"round(quantile_cont(value::DOUBLE, {p}), 6) AS p{int(p * 100)}" for p in _PERCENTS) + " FROM events GROUP BY event_type")
def percentile_summary(spark, sf_dir):
    own = [F.round(F.percentile("value", p), 6).alias(f"p{int(p * 100)}") for p in _PERCENTS]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), *own)


@query("SELECT user_id, s[floor(len(s) * 0.9)::INT + 1] AS p90 FROM (SELECT user_id, list(value ORDER BY value) AS s FROM events GROUP BY user_id) WHERE len(s) >= 10")
def nearest_rank_p90(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("s")).where(F.size("s") >= 10)
    return g.select("user_id", F.get("s", F.floor(F.size("s") * 0.9).cast("int")).alias("p90"))


_LIFT = "CASE WHEN value >= 60 THEN 'large' WHEN value >= 30 THEN 'some' WHEN value > 5 THEN 'none' ELSE 'worse' END"


@query(f"SELECT {_LIFT} AS bucket, count(*) AS n FROM events GROUP BY 1")
def lift_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.expr(_LIFT).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' WHEN n <= 50 THEN '21-50' ELSE '50+' END AS bucket, count(*) AS orders FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) GROUP BY 1")
def chunk_count_buckets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    bucket = F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 50, "21-50").otherwise("50+")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_totalprice > 100000) AS large, count(o_orderdate) AS dated FROM orders")
def filtered_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count("o_orderdate").alias("dated"))


@query("SELECT label, max(len(embedding))::INT AS dims, count(*) AS n FROM embeddings GROUP BY label")
def embedding_dims(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).alias("dims"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def event_type_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT topic, n, row_number() OVER (ORDER BY n DESC, topic)::INT AS place FROM (SELECT lower(trim(c_mktsegment)) AS topic, count(*) AS n FROM customer GROUP BY 1)")
def group_size_order(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy(F.lower(F.trim("c_mktsegment")).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "topic")))  # one row a segment


@query("SELECT CASE WHEN user_id % 5 = 0 THEN 'unlinked' ELSE (user_id % 5)::VARCHAR END AS project, count(DISTINCT user_id) AS sessions, max(ts) AS latest FROM events GROUP BY 1")
def session_groups(spark, sf_dir):
    project = F.when(F.col("user_id") % 5 == 0, "unlinked").otherwise((F.col("user_id") % 5).cast("string"))
    return table(spark, sf_dir, "events").groupBy(project.alias("project")).agg(F.countDistinct("user_id").alias("sessions"), F.max("ts").alias("latest"))


@query("SELECT event_type, round(count(*) / greatest(sum(value), 0.001), 6) AS per_second, round(sum(value) / greatest(count(*), 1), 6) AS seconds_each FROM events GROUP BY event_type")
def throughput_stats(spark, sf_dir):
    n, s = F.count(F.lit(1)), F.sum("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(n / F.greatest(s, F.lit(0.001)), 6).alias("per_second"), F.round(s / F.greatest(n, F.lit(1)), 6).alias("seconds_each"))


@query("""WITH c AS (SELECT doc_id, text, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS section FROM documents)
SELECT coalesce(section, 'none') AS section, count(*) AS chunks, count(vec_id) AS embedded, count(DISTINCT len(embedding)) AS sizes, count(*) FILTER (regexp_matches(text, '[=<>]')) AS math_like FROM c LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1""")
def chunk_corpus_quality(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("section"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dims"))
    return c.join(e, "doc_id", "left").groupBy(F.coalesce("section", F.lit("none")).alias("section")).agg(F.count(F.lit(1)).alias("chunks"), F.count("dims").alias("embedded"), F.countDistinct("dims").alias("sizes"), F.count_if(F.col("text").rlike("[=<>]")).alias("math_like"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1, 2")
def pricing_summary(spark, sf_dir):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


_STATED = {"primary": "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'unclear' END", "verified": "CASE o_orderstatus WHEN 'O' THEN 'high' WHEN 'F' THEN 'low' ELSE 'none' END"}


@query(f"""SELECT o_orderkey, CASE WHEN CASE v WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END > CASE p WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END THEN v ELSE p END AS confidence
FROM (SELECT o_orderkey, {_STATED['primary']} AS p, {_STATED['verified']} AS v FROM orders)""")
def confidence_min(spark, sf_dir):
    """Of two stated confidences the lower one; a word that is none counts as medium, and the first stays if both are alike."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", *(F.expr(x).alias(name) for name, x in _STATED.items()))
    return o.select("o_orderkey", vx.lower_confidence(F.col("primary"), F.col("verified")).alias("confidence"))