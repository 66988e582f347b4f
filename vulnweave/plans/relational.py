"""Queries: joins, aggregates, rankings and set operations that the pipelines are made of, over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import sinks
from .registry import Fixture, query, table


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 1000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def lookup_default(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "customer").join(known, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("SELECT s_name, max(s_acctbal) AS balance, arg_max(n_name, s_suppkey) AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_name")
def lookup_last_wins(spark, sf_dir):
    met = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return met.groupBy("s_name").agg(F.max("s_acctbal").alias("balance"), F.max_by("n_name", "s_suppkey").alias("nation"))


@query("SELECT coalesce(c_custkey, s_suppkey) AS place, c_name, s_name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def zip_join(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), "c_name")
    return R.zip_rows(left, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), "s_name"), "place")


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS id, c_name AS name, 'customer' AS language, 'c' AS package_manager FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier', 's' FROM supplier")
def union_all_tagged(spark, sf_dir):
    tag = lambda df, key, name, language, manager: df.select(F.col(key).alias("id"), F.col(name).alias("name"), F.lit(language).alias("language"), F.lit(manager).alias("package_manager"))
    return tag(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "customer", "c").unionByName(tag(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "supplier", "s"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def ordered_distinct(spark, sf_dir):
    return R.ordered_distinct(table(spark, sf_dir, "events"), "event_type", "event_id", ["user_id"])


@query("SELECT p_name, p_partkey, p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def distinct_on_first(spark, sf_dir):
    return R.distinct_on(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand", "p_retailprice"), ["p_name"], [F.col("p_partkey")])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey >= 10")
def ordered_concat_minus(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return R.concat_minus(nation.where("n_nationkey < 10"), nation.where("n_nationkey % 2 = 0"), ["n_nationkey"])


@query("SELECT l_suppkey, rank, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 3")
def topk_per_group_stable(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return R.top_k(items, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "rank", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_custkey, arg_min(o_orderkey, {'p': substr(o_orderpriority, 1, 1), 'k': o_orderkey}) AS o_orderkey, count(*) AS n FROM orders GROUP BY o_custkey")
def priority_primary(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(F.substring("o_orderpriority", 1, 1), "o_orderkey")).alias("o_orderkey"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name DESC, p_partkey) AS INTEGER) AS place, p_brand FROM part")
def score_rank(spark, sf_dir):
    return R.top_k(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.desc("p_name"), F.col("p_partkey")], 1 << 30, "place").select("p_partkey", "p_name", "place", "p_brand")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type ORDER BY n DESC, first_seen")
def most_common(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen")


@query("SELECT o_orderpriority AS risk_level, count(*) AS n FROM orders GROUP BY o_orderpriority")
def risk_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0) AS discounted, count(*) FILTER (WHERE l_tax >= 0.04) AS taxed, count(*) FILTER (WHERE l_linestatus LIKE 'O%') AS open_lines FROM lineitem GROUP BY l_returnflag")
def conditional_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0).alias("discounted"), F.count_if(F.col("l_tax") >= 0.04).alias("taxed"), F.count_if(F.col("l_linestatus").startswith("O")).alias("open_lines"))


@query("SELECT d.event_type, coalesce(n, 0) AS n FROM (SELECT unnest(['click', 'error', 'purchase', 'refund']) AS event_type) d LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) USING (event_type)")
def confidence_distribution(spark, sf_dir):
    return R.counts_over(table(spark, sf_dir, "events"), "event_type", ["click", "error", "purchase", "refund"])


@query("SELECT event_type AS language, count(DISTINCT user_id) AS projects, count(*) FILTER (WHERE value > 5) AS success, count(*) FILTER (WHERE value <= 5) AS failed, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS dependencies FROM events GROUP BY event_type")
def parse_statistics(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("language")).agg(F.countDistinct("user_id").alias("projects"), F.count_if(F.col("value") > 5).alias("success"), F.count_if(F.col("value") <= 5).alias("failed"), F.sum(k).alias("dependencies"))


@query("SELECT l_suppkey, list_sort(list_distinct(list(l_returnflag))) AS flags FROM lineitem GROUP BY l_suppkey")
def collect_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


@query("SELECT CAST(sum(n) AS BIGINT) AS labels FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def label_count_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("labels"))


@query("SELECT user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value", "event_id")
    return R.merge_latest(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id").drop("event_id")


@query("""SELECT n_regionkey, to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey))::VARCHAR AS json FROM nation GROUP BY n_regionkey""")
def json_array(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return sinks.json_array(nation, ["n_nationkey"], ["n_regionkey"]).withColumn("json", F.regexp_replace("json", r',"n_regionkey":\d+', ""))


@query("""SELECT s_suppkey, to_json({'code': 200, 'message': 'success', 'obj': s_name})::VARCHAR AS json FROM supplier""")
def response_envelope(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", sinks.envelope(F.lit(200), F.lit("success"), F.col("s_name")).alias("json"))


@query("""SELECT 'p' AS project_id, p_name AS name, coalesce(nullif(p_brand, 'Brand#1'), '') AS version, 'java' AS language, 'maven' AS package_manager, '' AS file_path, coalesce(p_type, '') AS description, TIMESTAMPTZ '2024-06-01 00:00:00+00' AS created_time, 0 AS isdelete FROM part""")
def white_list_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.nullif("p_brand", F.lit("Brand#1")).alias("version"), F.lit("java").alias("language"), F.lit("maven").alias("package_manager"), F.lit(None).cast("string").alias("file_path"), F.col("p_type").alias("description"))
    return sinks.white_list_rows(part, F.lit("p"), F.lit("2024-06-01 00:00:00+00:00").cast("timestamp"))


_SLOTS = Fixture("id int, a array<string>, b array<string>", [(0, ["x", "y"], ["x"]), (1, ["x"], []), (2, [], []), (3, ["p", "q", "r"], ["s", "t"])])


@query("""SELECT id, triple FROM (VALUES (0, 'x;y;'), (1, 'x;;'), (2, ';;'), (3, 'p;s;q')) AS t(id, triple)""")
def interleave_triple(spark, sf_dir):
    return _SLOTS.df(spark).select("id", R.interleave(F.col("a"), F.col("b")).alias("triple"))


@query("SELECT o_custkey, ((list(o_orderkey ORDER BY o_orderkey))[1:10] || [-1, -1, -1, -1, -1, -1, -1, -1, -1, -1])[1:10] AS padded FROM orders GROUP BY o_custkey")
def trim_pad_array(spark, sf_dir):
    best = R.top_k(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 10)
    return best.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l")).select("o_custkey", R.pad(F.col("l"), 10, -1).alias("padded"))
