"""Queries of changes to tables, constraints, user functions, sources and sinks, metadata, and the fluent builder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.functions import user
from quillon.operators import changes as C
from quillon.plans.fluent import Query
from quillon.plans.registry import query
from quillon.session import checkpoint_dir
from quillon.sources import csv, files, metadata, script
from quillon.streaming import fetch

c = F.col


def scratch(name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    s = SparkSession.active()
    return f"{checkpoint_dir(s)}/quillon/{s.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# Changes


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region")
def dml_insert(t):
    return C.insert(t("nation"), t("region").select((c("r_regionkey") + 100).alias("n_nationkey"), c("r_name").alias("n_name")))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal + 100, 2) ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSE' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(t):
    return C.update(t("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), {"c_acctbal": F.round(c("c_acctbal") + 100, 2), "c_mktsegment": F.lit("HOUSE")}, c("c_mktsegment") == "BUILDING")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(o_totalprice < 250000 AND o_orderstatus <> 'P', FALSE)")
def dml_delete(t):
    return C.delete(t("orders"), (c("o_totalprice") < 250000) & (c("o_orderstatus") != "P")).select("o_orderkey", "o_orderstatus")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE s_name END AS s_name, s_acctbal FROM supplier UNION ALL SELECT n_nationkey + 1000000, n_name, NULL FROM nation")
def dml_merge(t):
    s = t("supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("even").alias("s_name")).unionByName(t("nation").select((c("n_nationkey") + 1000000).cast("bigint").alias("s_suppkey"), c("n_name").alias("s_name")))
    return C.merge(s, new, ["s_suppkey"])


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def create_table_as(t):
    """Written as a table in the shared folder, then queried."""
    path = scratch("ctas")
    t("orders").where("o_totalprice > 100000").write.parquet(path)
    return SparkSession.active().read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size FROM part WHERE NOT coalesce(p_size > 5, TRUE)")
def constraint_check(t):
    return C.violations(t("part"), c("p_size") > 5).select("p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def constraint_unique(t):
    return C.duplicates(t("lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def constraint_foreign_key(t):
    return C.orphans(t("lineitem"), ["l_partkey"], t("part").where("p_size > 10"), ["p_partkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def constraint_set_null(t):
    _, child = C.referential_delete(t("nation"), c("n_regionkey") == 2, t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", "n_nationkey", "set null")
    return child


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
def constraint_cascade(t):
    _, child = C.referential_delete(t("nation"), c("n_regionkey") == 2, t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", "n_nationkey", "cascade")
    return child.select("c_custkey")


# User functions


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), '') AS ini FROM part")
def udf_scalar(t):
    f = user.create_alias(SparkSession.active(), "initials", user.initials, "string")
    return t("part").select("p_partkey", f("p_name").alias("ini"))


@query("SELECT p_brand, median(p_retailprice) AS med FROM part GROUP BY p_brand")
def udaf_median(t):
    """Spark's own median: distributed, unlike a Python aggregate."""
    return t("part").groupBy("p_brand").agg(F.median("p_retailprice").alias("med"))


@query("SELECT p_brand, CAST(max(p_size) - min(p_size) AS BIGINT) AS width FROM part GROUP BY p_brand")
def udaf_python(t):
    """A user aggregate with partial states, so no brand's rows meet in one task."""
    ends = user.aggregate_by_parts(t("part"), ["p_brand"], "p_size", lambda v: {"lo": int(v.min()), "hi": int(v.max())}, {"lo": F.min, "hi": F.max}, "lo bigint, hi bigint")
    return ends.select("p_brand", (c("hi") - c("lo")).alias("width"))


@query("SELECT n_regionkey, string_agg(left(n_name, 1), '' ORDER BY n_name) AS firsts FROM nation GROUP BY n_regionkey")
def udaf_whole_groups(t):
    f = user.create_aggregate(SparkSession.active(), "firsts", lambda v: "".join(x[0] for x in sorted(v)), "string")
    return t("nation").groupBy("n_regionkey").agg(f("n_name").alias("firsts"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, CAST(generate_subscripts(string_split(p_name, ' '), 1) AS INTEGER) AS at FROM part")
def udtf_split(t):
    s = SparkSession.active()
    s.udtf.register("split_words", user.SplitWords)
    t("part").createOrReplaceTempView("part")
    return s.sql("SELECT p_partkey, w.word, w.at FROM part, LATERAL split_words(p_name) w")


# Sources and sinks


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(t):
    path = scratch("csv")
    csv.csv_write(t("customer").select("c_custkey", "c_name", "c_mktsegment"), path, "fieldSeparator=; null=NA")
    return csv.csv_read(SparkSession.active(), path, None, "fieldSeparator=; null=NA")


@query("SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem WHERE l_orderkey BETWEEN 100 AND 200")
def clustered_table(t):
    path = scratch("clustered")
    files.write_clustered(t("lineitem"), path, "l_orderkey")
    return SparkSession.active().read.parquet(path).where(c("l_orderkey").between(100, 200)).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("s"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def script_round_trip(t):
    s = SparkSession.active()
    t("nation").createOrReplaceTempView("nation")
    t("region").createOrReplaceTempView("region")
    folder = scratch("dump")
    script.dump(s, folder, "nation", "region")
    script.restore(s, folder)
    return script.run_script(s, "SELECT 'a;b'; -- a comment; with a mark\nSELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey;")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_append(t):
    """Copied as a stream of new files, each exactly once, then counted."""
    s, source, target = SparkSession.active(), scratch("stream-in"), scratch("stream-out")
    t("events").write.parquet(source)
    fetch.append_new(s, source, t("events"), target, scratch("stream-state"))
    return s.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"))


# Metadata


@query("SELECT 'nation' AS table_name, * FROM (VALUES ('n_nationkey', 1), ('n_name', 2), ('n_regionkey', 3)) v(column_name, ordinal_position)")
def info_columns(t):
    t("nation").createOrReplaceTempView("nation")
    return metadata.columns(SparkSession.active()).where("table_name = 'nation'").select("table_name", "column_name", "ordinal_position")


@query("SELECT 'region' AS table_name, 'TEMPORARY' AS table_type")
def info_tables(t):
    t("region").createOrReplaceTempView("region")
    return metadata.tables(SparkSession.active()).where("table_name = 'region'").select("table_name", "table_type")


@query()
def info_settings(t):
    return metadata.settings(SparkSession.active())


@query()
def info_functions(t):
    return metadata.functions(SparkSession.active())


@query()
def explain_plan(t):
    """The formatted plan of a join, a line a row."""
    t("orders").createOrReplaceTempView("orders")
    s = SparkSession.active()
    return s.sql("EXPLAIN FORMATTED SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey")


# The fluent builder


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 AND (o_orderstatus = 'F' OR o_orderpriority LIKE '1%') GROUP BY c_mktsegment HAVING count(*) > 3")
def fluent_join_group(t):
    q = Query(t("customer")).join(t("orders"), c("c_custkey") == c("o_custkey"))
    q = q["c_acctbal"].gt(0).and_().lp()["o_orderstatus"].eq("F").or_()["o_orderpriority"].like("1%").rp()
    q = q.group_by("c_mktsegment").select("c_mktsegment", F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).having()
    return q["n"].gt(3).to_df()


@query("SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%ring%' AND NOT p_size IN (1, 2, 3)) OR p_brand = 'Brand#1' ORDER BY p_partkey LIMIT 25 OFFSET 5")
def fluent_paging(t):
    q = Query(t("part")).lp()["p_name"].icontains("RING").and_().not_()["p_size"].isin(1, 2, 3).rp().or_()["p_brand"].eq("Brand#1")
    return q["p_partkey"].asc().select("p_partkey", "p_name").limit(25).offset(5).to_df()


@query("SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def fluent_json(t):
    return t("region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("json"))


@query("SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def json_fields(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
