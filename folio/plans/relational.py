"""Queries over filters, joins, sorts, pages and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import values as vx
from folio.plans.registry import query
from folio.sources import sinks
from folio.sources.tables import table

# --- filters ----------------------------------------------------------------------------------------------------

_PART = "SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS size FROM part"


def _typed(spark, sf_dir):
    """The part table with a nullable field and a number kept as text."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("brand"),
        F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("size"),
    )


def _register_typed(op: str, field: str, value, where: str) -> None:
    def run(spark, sf_dir):
        name = "is_null" if op == "is_null" else op
        return _typed(spark, sf_dir).where(vx.typed_predicate(F.col(field), "eq" if name == "is_null" else op, value)).select("p_partkey")

    query(f"SELECT p_partkey FROM ({_PART}) WHERE {where}", name=f"typed_filter_{op}")(run)


for _op, _field, _value, _where in (
    ("eq", "brand", "Brand#11", "brand = 'Brand#11'"),
    ("neq", "brand", "Brand#11", "brand <> 'Brand#11'"),
    ("contains", "p_name", "a", "contains(p_name, 'a')"),
    ("gt", "size", 25, "TRY_CAST(size AS DOUBLE) > 25"),
    ("gte", "size", 25, "TRY_CAST(size AS DOUBLE) >= 25"),
    ("lt", "size", 10, "TRY_CAST(size AS DOUBLE) < 10"),
    ("lte", "size", "10", "TRY_CAST(size AS DOUBLE) <= 10"),
    ("in", "brand", ["Brand#11", "Brand#22", "Brand#33"], "brand IN ('Brand#11', 'Brand#22', 'Brand#33')"),
    ("is_null", "brand", None, "brand IS NULL"),
):
    _register_typed(_op, _field, _value, _where)


@query("SELECT c_custkey, c_name FROM customer WHERE (CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'low' ELSE 'high' END) IS DISTINCT FROM 'low'")
def filter_null_safe_neq(spark, sf_dir):
    label = F.when(F.col("c_custkey") % 3 == 1, "low").when(F.col("c_custkey") % 3 == 2, "high")
    return table(spark, sf_dir, "customer").where(~label.eqNullSafe("low")).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'steel') OR contains(lower(p_brand), '#1')")
def search_multi_column(spark, sf_dir):
    found = reduce(lambda c, x: c | F.lower(x[0]).contains(x[1]), (("p_type", "steel"), ("p_brand", "#1")), F.lower("p_name").contains("red"))
    return table(spark, sf_dir, "part").where(found).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, sf_dir):
    """A page after the last key of the one before: a limit is what it is for."""
    return table(spark, sf_dir, "orders").where("o_orderkey > 500").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_owned(spark, sf_dir):
    mine = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(mine, "o_custkey", "left_semi").select("o_orderkey")


# --- joins ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O'")
def join_three_way(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS enriched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_outer_enrichment(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumn("enriched", F.lit(True))
    return d.join(l, "doc_id", "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("enriched", F.lit(False)).alias("enriched"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def left_join_default_zero(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_label, doc_id IN (SELECT vec_id FROM embeddings) AS has_vector FROM documents")
def exists_flags(spark, sf_dir):
    has = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("doc_id")).distinct().withColumn(f"in_{name}", F.lit(True))
    d = table(spark, sf_dir, "documents").join(has("labels", "doc_id"), "doc_id", "left").join(has("embeddings", "vec_id"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("in_labels", F.lit(False)).alias("has_label"), F.coalesce("in_embeddings", F.lit(False)).alias("has_vector"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_name IN (SELECT s_name FROM supplier) OR c_mktsegment IN (SELECT r_name FROM region)")
def semi_any_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = c.select("c_custkey", F.explode(F.array(F.struct(F.lit("id").alias("kind"), F.col("c_custkey").cast("string").alias("value")), F.struct(F.lit("name").alias("kind"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("kind"), F.col("c_mktsegment").alias("value")))).alias("k"))
    known = [
        table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit("id").alias("kind"), F.col("o_custkey").cast("string").alias("value")),
        table(spark, sf_dir, "supplier").select(F.lit("name").alias("kind"), F.col("s_name").alias("value")),
        table(spark, sf_dir, "region").select(F.lit("segment").alias("kind"), F.col("r_name").alias("value")),
    ]
    keys = reduce(lambda a, b: a.unionByName(b), known).distinct()
    return own.select("c_custkey", "k.kind", "k.value").join(keys, ["kind", "value"], "left_semi").select("c_custkey").distinct()


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE (doc_id, sha256(text)) NOT IN (SELECT doc_id, sha256(text) FROM documents JOIN labels USING (doc_id))")
def anti_incremental(spark, sf_dir):
    """Rows whose content was not processed before."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    done = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return d.join(done, ["doc_id", "hash"], "left_anti")


@query("SELECT c_nationkey, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS children FROM customer GROUP BY c_nationkey")
def nest_children(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("c_custkey")).alias("c"))
    return g.select("c_nationkey", "n", F.array_join(F.col("c").cast("array<string>"), ",").alias("children"))


_RESERVED = "(VALUES ('brand', 1, 'text'), ('size', 2, 'text'), ('type', 3, 'text'))"
_OWN = "(VALUES ('size', 1, 'number'), ('price', 2, 'number'))"


@query(f"""SELECT coalesce(r.k, o.k) AS key, CASE WHEN r.k IS NOT NULL THEN r.t ELSE o.t END AS type, CASE WHEN r.k IS NOT NULL THEN r.i ELSE 100 + o.i END AS place
FROM {_RESERVED} r(k, i, t) FULL JOIN {_OWN} o(k, i, t) ON r.k = o.k""")
def schema_merge(spark, sf_dir):
    """Reserved fields keep their type and come first; own fields follow."""
    r = spark.sql(f"SELECT * FROM {_RESERVED} AS t(key, ri, rt)")
    o = spark.sql(f"SELECT * FROM {_OWN} AS t(key, oi, ot)")
    return r.join(o, "key", "full").select("key", F.coalesce("rt", "ot").alias("type"), F.coalesce("ri", F.col("oi") + 100).alias("place"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'rejected_type' WHEN n_chars > 20000 THEN 'too_large' WHEN min(doc_id) OVER (PARTITION BY sha256(text)) < doc_id THEN 'duplicate' ELSE 'accepted' END AS status FROM documents""")
def upload_dedup_status(spark, sf_dir):
    """What becomes of uploaded files: the first of equal contents is taken."""
    d = table(spark, sf_dir, "documents").withColumn("hash", F.sha2("text", 256))
    first = d.groupBy("hash").agg(F.min("doc_id").alias("first"))
    status = F.when(F.col("doc_id") % 10 == 9, "rejected_type").when(F.col("n_chars") > 20000, "too_large").when(F.col("first") < F.col("doc_id"), "duplicate").otherwise("accepted")
    return d.join(first, "hash").select("doc_id", status.alias("status"))


@query("""SELECT c_custkey, c_name || '!' AS name, c_acctbal + 1 AS balance FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0""")
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = old.where("balance < 0").select("c_custkey", F.concat("name", F.lit("!")).alias("name"), (F.col("balance") + 1).alias("balance"))
    return sinks.upserted(old, new, ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name, c_acctbal AS balance FROM customer")
def upsert_fill_nulls(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("balance"))
    new = c.select("c_custkey", F.lit("new").alias("name"), F.lit(0.0).alias("balance"))
    return sinks.filled(old, new, ["c_custkey"])


# --- sorts and pages --------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def sort_dynamic(spark, sf_dir, key: str = "balance", descending: bool = True):
    column = {"balance": "c_acctbal", "name": "c_name"}[key]
    order = F.col(column).desc() if descending else F.col(column).asc()
    return table(spark, sf_dir, "customer").orderBy(order, "c_custkey").limit(20).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_name, c_custkey LIMIT 25 OFFSET 50")
def page_with_total(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    total = c.agg(F.count(F.lit(1)).alias("total"))  # one row
    return c.orderBy("c_name", "c_custkey").offset(50).limit(25).select("c_custkey").crossJoin(F.broadcast(total))


@query("SELECT user_id, count(*) AS n, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM events GROUP BY user_id")
def page_slice(spark, sf_dir):
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("n"), F.greatest(F.lit(1), F.ceil(n / 20.0)).cast("long").alias("pages"))


_RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END"


@query(f"SELECT o_orderkey, {_RANK} AS rank FROM orders ORDER BY rank, o_orderdate DESC, o_orderkey LIMIT 50")
def sort_case_rank(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("rank", F.expr(_RANK))
    return o.orderBy("rank", F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "rank")


@query("SELECT p_partkey FROM part ORDER BY p_size % 3, coalesce(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END, 0) DESC, p_partkey LIMIT 40")
def sort_tiered(spark, sf_dir):
    year = F.coalesce(F.when(F.col("p_size") % 7 != 0, F.col("p_size")), F.lit(0))
    return table(spark, sf_dir, "part").orderBy(F.col("p_size") % 3, year.desc(), "p_partkey").limit(40).select("p_partkey")


@query("SELECT c_nationkey, c_custkey FROM customer WHERE true QUALIFY row_number() OVER (ORDER BY CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END NULLS LAST, c_custkey) <= 30")
def sort_nulls_last(spark, sf_dir):
    key = F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").orderBy(key.asc_nulls_last(), "c_custkey").limit(30).select("c_nationkey", "c_custkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def recent_n(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select("o_orderkey", "o_orderdate")


@query('SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 1 HOUR END, ts) AS "at" FROM events ORDER BY "at", event_id LIMIT 100')
def event_time_sort(spark, sf_dir):
    at = F.coalesce(F.when(F.col("event_id") % 4 != 0, F.expr("ts + INTERVAL 1 HOUR")), F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", at.alias("at")).orderBy("at", "event_id").limit(100)


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_size % 4, CASE WHEN contains(p_type, 'STEEL') THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey)::INT AS place FROM part QUALIFY place <= least(180, greatest(75, 75))""")
def candidate_prerank(spark, sf_dir, target: int = 25):
    """The candidates that scoring looks at: category, boost, agreement and age in turn, and a bound on their number."""
    order = [F.col("p_size") % 4, F.when(F.col("p_type").contains("STEEL"), 0).otherwise(1), F.desc("p_retailprice"), F.col("p_partkey")]
    top = table(spark, sf_dir, "part").orderBy(*order).limit(min(180, max(target * 3, target + 50)))
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("p_partkey", "place")


@query("SELECT doc_id, CASE quality WHEN 1 THEN 'high' ELSE 'medium' END AS score FROM labels WHERE toxic = 0 ORDER BY score, doc_id LIMIT 25")
def screening_pick(spark, sf_dir):
    picked = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("medium").alias("score"))
    return picked.orderBy("score", "doc_id").limit(25)


@query("SELECT event_id, 10 - (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10")
def rerank_identity(spark, sf_dir):
    """Without a reranker the first of n documents scores n - 1, the last 0."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("place", place).where("place <= 10").select("event_id", (F.lit(10) - F.col("place")).alias("score"))


# --- set operations ---------------------------------------------------------------------------------------------

_MEASURES = "SELECT o_custkey AS key, 'orders' AS measure, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'open', count(*) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 UNION ALL SELECT o_custkey, 'lines', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"


@query(_MEASURES)
def union_all_measures(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    count = lambda df, m: df.groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key", F.lit(m).alias("measure"), "n")
    lines = l.join(o, l.l_orderkey == o.o_orderkey)
    return count(o, "orders").unionByName(count(o.where("o_orderstatus = 'O'"), "open")).unionByName(count(lines, "lines"))


@query("SELECT DISTINCT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_uncited(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(cited, "p_partkey", "left_anti").distinct()


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def intersect_users(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'purchase'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@query("SELECT p_partkey FROM part WHERE p_brand <> 'Brand#11' OR p_brand IS NULL")
def bulk_delete(spark, sf_dir):
    """What is left after a delete by predicate."""
    return table(spark, sf_dir, "part").where(~F.col("p_brand").eqNullSafe("Brand#11")).select("p_partkey")


@query("SELECT k AS key, ov AS old_version, nv AS new_version, ov IS DISTINCT FROM nv AS drifted FROM (SELECT p_partkey AS k, p_size % 3 AS ov, CASE WHEN p_partkey % 4 = 0 THEN p_size % 3 + 1 ELSE p_size % 3 END AS nv FROM part)")
def schema_drift(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("key"), (F.col("p_size") % 3).alias("old_version"))
    new = p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") % 3 + 1).otherwise(F.col("p_size") % 3).alias("new_version"))
    return old.join(new, "key", "full").select("key", "old_version", "new_version", (~F.col("old_version").eqNullSafe(F.col("new_version"))).alias("drifted"))
