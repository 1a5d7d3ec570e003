"""Queries for reports: rates, evaluation tables, events, grouping sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..streaming.events import event_windows
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("SELECT lang, count(quality) AS samples, sum(quality)::BIGINT AS correct, round(100.0 * sum(quality) / count(quality), 6) AS accuracy, round(avg(toxic), 6) AS mean_toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def method_accuracy(t):
    return reports.method_accuracy(t("labels").join(t("documents").select("doc_id", "lang"), "doc_id"), "lang", correct="quality", metrics=("toxic",))


@R.add("""SELECT source, lang, count(quality) AS samples, sum(quality)::BIGINT AS correct, round(100.0 * sum(quality) / count(quality), 6) AS accuracy
FROM labels JOIN documents USING (doc_id) WHERE source IN (SELECT source FROM labels JOIN documents USING (doc_id) GROUP BY source HAVING count(DISTINCT lang) > 1) GROUP BY 1, 2""")
def multi_method_docs(t):
    rows = t("labels").join(t("documents").select("doc_id", "source", "lang"), "doc_id")
    several = rows.groupBy("source").agg(F.countDistinct("lang").alias("n")).filter("n > 1").select("source")
    return reports.method_accuracy(rows.join(several, "source", "left_semi"), "source", "lang", correct="quality")


@R.add("SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (lang, source)")
def cube_lang_source(t):
    out = t("documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return out.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "chars")


@R.add("""SELECT coalesce(r_name, '*') AS r_name, coalesce(n_name, '*') AS n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_region_nation(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return out.select(F.coalesce("r_name", F.lit("*")).alias("r_name"), F.coalesce("n_name", F.lit("*")).alias("n_name"), "n", "balance")


@R.add("""SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def grouping_sets_orders(t):
    cols = [F.col("o_orderstatus"), F.col("o_orderpriority")]
    out = t("orders").groupingSets([[cols[0]], [cols[1]], []], *cols).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@R.add("""SELECT doc_id, 'quality' AS method, quality AS answer FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels""")
def unpivot_results(t):
    return reports.unpivot_methods(t("labels"), ["doc_id"], ["quality", "toxic"])


@R.add("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def event_metrics(t):
    return reports.event_metrics(t("events"), "event_type", "value")


@R.add("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS successful, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS skipped,
  round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate FROM events GROUP BY user_id""")
def batch_summary(t):
    kind = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "failed").otherwise("skipped")
    return reports.batch_summary(t("events").withColumn("outcome", kind), "user_id")


@R.add("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(t):
    return event_windows(t("events"), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add("""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def event_sliding(t):
    return event_windows(t("events"), "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def props_json(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@R.add("""SELECT CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') THEN 'metal' WHEN contains(lower(p_type), 'small') THEN 'small' ELSE 'other' END AS kind, count(*) AS n, round(avg(p_retailprice), 4) AS price
FROM part GROUP BY 1""")
def doc_type_stats(t):
    kind = reports.classify(F.col("p_type"), {"metal": ["steel", "tin"], "small": ["small"]}, "other")
    return t("part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@R.add("""SELECT id, num FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN source ELSE doc_id || '/' || source END AS id,
  CASE WHEN doc_id % 4 = 0 THEN 1000000000 ELSE doc_id END AS num FROM documents) ORDER BY num, id LIMIT 25""")
def report_sort_limit(t):
    ident = F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.concat_ws("/", F.col("doc_id").cast("string"), "source"))
    rows = t("documents").select(ident.alias("id"))
    return rows.withColumn("num", reports.folder_number(F.col("id"))).orderBy("num", "id").limit(25)


@R.add("""SELECT doc_id, toxic = 1 OR length(CASE WHEN quality = 0 THEN 'low' END) > 0 IS TRUE AS failed,
  concat_ws('; ', CASE WHEN toxic = 1 THEN 'toxic: yes' END, CASE WHEN quality = 0 THEN 'quality: low' END) AS summary FROM labels""")
def error_rows(t):
    rows = t("labels").select("doc_id", F.when(F.col("toxic") == 1, "yes").alias("toxic"), F.when(F.col("quality") == 0, "low").alias("quality"))
    return rows.select("doc_id", reports.any_error(F.col("toxic"), F.col("quality")).alias("failed"), reports.error_summary(["toxic", "quality"]).alias("summary"))


@R.add("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS text FROM documents")
def report_texts(t):
    return t("documents").select("doc_id", reports.shown(F.col("text"), 100).alias("text"))


@R.add()
def approx_users(t):
    return t("events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@R.add("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = t("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@R.add("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
