"""Queries of scans, predicates, joins, aggregation, ordering, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import aggregates as A
from quillon.operators import relational as R
from quillon.operators.sequences import numbered
from quillon.plans.registry import query, sql_query
from quillon.sources import generated as G

# Scans and projections


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def scan_projected(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 2000")
def scan_key_range(t):
    return t("orders").where(F.col("o_orderkey").between(1000, 2000)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT * FROM customer WHERE c_custkey = 77")
def scan_key_lookup(t):
    return t("customer").where("c_custkey = 77")


@query("SELECT DISTINCT c_mktsegment FROM customer")
def scan_distinct_keys(t):
    return t("customer").select("c_mktsegment").distinct()


@query("SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders")
def scan_min_max(t):
    return t("orders").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count("*").alias("n"))


@query("SELECT x FROM range(1, 1001) r(x)")
def range_rows(t):
    return G.system_range(SparkSession.active(), 1, 1000)


@query("SELECT x FROM range(1, 1001, 7) r(x)")
def range_step(t):
    return G.system_range(SparkSession.active(), 1, 1000, 7)


@query("SELECT CAST(1 AS BIGINT) AS x")
def dual_row(t):
    return G.dual(SparkSession.active())


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (NULL, 'c')) v(c1, c2)")
def values_rows(t):
    return G.values(SparkSession.active(), (1, "a"), (2, "b"), (None, "c"))


@query("SELECT * FROM (VALUES (1, 'Hello'), (2, 'World'), (3, NULL)) v(id, name)")
def table_function(t):
    return G.table_of(SparkSession.active(), id=("INT", [1, 2, 3]), name=("VARCHAR", ["Hello", "World"]))


@query("SELECT * FROM (VALUES (1, 'Hello'), (2, 'World')) v(id, name)")
def table_function_distinct(t):
    return G.table_of(SparkSession.active(), True, id=("INT", [1, 2, 2]), name=("VARCHAR", ["Hello", "World", "World"]))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_linenumber * 2 + 1 AS odd, -l_quantity AS minus FROM lineitem")
def project_expressions(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), (F.col("l_linenumber") * 2 + 1).alias("odd"), (-F.col("l_quantity")).alias("minus"))


sql_query("from_first", "FROM nation SELECT n_name, n_nationkey", None, "nation")
sql_query("wildcard_join", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None, "nation", "region")

# Predicates


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'N'")
def filter_compare(t):
    return t("lineitem").where("l_quantity >= 45 and l_discount < 0.03 and l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(t):
    return t("part").where(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def filter_in(t):
    return t("customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%' AND p_brand LIKE 'Brand#1_'")
def filter_like(t):
    return t("part").where(F.col("p_name").like("%widget%") & F.col("p_brand").like("Brand#1_")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red\\_%' ESCAPE '\\' OR p_name LIKE 'r%'")
def filter_like_escape(t):
    return t("part").where(F.expr(r"p_name LIKE 'red#_%' ESCAPE '#' OR p_name LIKE 'r%'")).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '#0*[1-9]7$') AND NOT regexp_matches(lower(c_mktsegment), '^b')")
def filter_regexp(t):
    return t("customer").where(F.col("c_name").rlike("#0*[1-9]7$") & ~F.col("c_mktsegment").rlike("(?i)^B")).select("c_custkey")


@query(
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL OR o_orderstatus IS NOT DISTINCT FROM 'F' OR o_orderpriority IS DISTINCT FROM '5-LOW'"
)
def filter_null_safe(t):
    j = t("customer").join(t("orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.where(F.col("o_orderkey").isNull() | F.col("o_orderstatus").eqNullSafe("F") | ~F.col("o_orderpriority").eqNullSafe("5-LOW")).select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000) AND (o_orderpriority = '1-URGENT' OR o_custkey < 100)")
def filter_boolean(t):
    return t("orders").where("not (o_orderstatus = 'F' or o_totalprice < 100000) and (o_orderpriority = '1-URGENT' or o_custkey < 100)").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity, l_linenumber) >= (40, 3)")
def filter_row_value(t):
    return t("lineitem").where(F.struct("l_quantity", "l_linenumber") >= F.struct(F.lit(40.0), F.lit(3))).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_partkey // 7 AS quotient, p_partkey % 7 AS rest, CAST(p_size AS VARCHAR) || '/' || p_brand AS joined, CAST(trunc(p_retailprice) AS BIGINT) AS cut FROM part")
def operators_mixed(t):
    return t("part").select(
        "p_partkey", F.expr("p_partkey div 7").alias("quotient"), (F.col("p_partkey") % 7).alias("rest"), F.concat(F.col("p_size").cast("string"), F.lit("/"), F.col("p_brand")).alias("joined"), F.col("p_retailprice").cast("bigint").alias("cut")
    )


@query("SELECT vec_id, embedding[1] AS first, embedding[64] AS last, embedding[65] IS NULL AS out_of_range FROM embeddings")
def array_index(t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", F.get(e, 0).alias("first"), F.get(e, 63).alias("last"), F.get(e, 64).isNull().alias("out_of_range"))


@query("SELECT o_orderkey, CAST(DATE '2000-01-01' AS VARCHAR) AS d, o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AS early, 'it''s' AS quoted FROM orders WHERE o_orderdate >= DATE '1998-06-01'")
def literals(t):
    return t("orders").where("o_orderdate >= DATE '1998-06-01'").select("o_orderkey", F.expr("string(DATE '2000-01-01')").alias("d"), F.expr("o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'").alias("early"), F.lit("it's").alias("quoted"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
def parameters(t):
    t("customer").createOrReplaceTempView("customer")
    return SparkSession.active().sql("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > ? AND c_mktsegment = ?", args=[9000, "BUILDING"])


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 + 1500")
def session_variable(t):
    s = SparkSession.active()
    t("customer").createOrReplaceTempView("customer")
    s.sql("DECLARE OR REPLACE VARIABLE least_balance DOUBLE DEFAULT 5000")
    s.sql("SET VAR least_balance = least_balance + 1500")
    return s.sql("SELECT c_custkey FROM customer WHERE c_acctbal > session.least_balance")


# Joins


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(t):
    return t("orders").join(t("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def join_left(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def join_right(t):
    return R.right_join(t("orders").where("o_orderstatus = 'P'"), t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT r_name, n_name FROM region, nation WHERE n_nationkey < 5")
def join_product(t):
    return t("region").crossJoin(t("nation").where("n_nationkey < 5")).select("r_name", "n_name")


@query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
def join_natural(t):
    return R.natural_join(t("nation").select(F.col("n_regionkey").alias("k"), "n_name"), t("region").select(F.col("r_regionkey").alias("k"), "r_name"))


@query("SELECT n_name, c_custkey, o_orderkey FROM nation LEFT JOIN (customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000) ON n_nationkey = c_nationkey")
def join_nested(t):
    inner = t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"))
    return t("nation").join(inner, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "c_custkey", "o_orderkey")


@query("SELECT s_suppkey, r_name FROM supplier JOIN region ON s_nationkey % 5 < r_regionkey")
def join_theta(t):
    return t("supplier").join(R.small(t("region")), F.col("s_nationkey") % 5 < F.col("r_regionkey")).select("s_suppkey", "r_name")


@query("SELECT e.event_id, p.p_partkey FROM events e JOIN part p ON e.value BETWEEN p.p_retailprice / 100 - 0.001 AND p.p_retailprice / 100 + 0.001")
def join_band(t):
    p = t("part").select("p_partkey", (F.col("p_retailprice") / 100 - 0.001).alias("lo"), (F.col("p_retailprice") / 100 + 0.001).alias("hi"))
    return R.band_join(t("events").select("event_id", "value"), p, "value", "lo", "hi", 0.01).select("event_id", "p_partkey")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(t):
    a, b = t("supplier").alias("a"), t("supplier").alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_in(t):
    return t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)")
def semi_exists(t):
    return t("part").join(t("lineitem").where("l_quantity = 50"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_not_exists(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def anti_not_in(t):
    return R.not_in(t("supplier"), "s_nationkey", t("customer").where("c_acctbal > 9900").select("c_nationkey")).select("s_suppkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_regionkey = 1)")
def anti_not_in_null(t):
    return R.not_in(t("supplier"), "s_nationkey", t("nation").where("n_regionkey = 1").select(F.expr("nullif(n_nationkey, 3)").alias("v"))).select("s_suppkey")


# Aggregation


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem WHERE l_returnflag = 'R'")
def agg_global(t):
    return t("lineitem").where("l_returnflag = 'R'").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"), F.round(F.avg("l_quantity"), 6).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT year(o_orderdate) AS y, o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_group_expr(t):
    return t("orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y"), (F.col("o_custkey") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND sum(o_totalprice) > 1000000")
def agg_having(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s")).where("n > 15 and s > 1000000").select("o_custkey", "n", F.round("s", 2).alias("total"))


@query("SELECT count(*) AS n FROM orders HAVING count(*) > 1000000000")
def agg_having_global(t):
    return t("orders").agg(F.count("*").alias("n")).where("n > 1000000000")


@query("SELECT l_shipmonth, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem) GROUP BY l_shipmonth")
def agg_distinct(t):
    return t("lineitem").groupBy(F.month("l_shipdate").cast("bigint").alias("l_shipmonth")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum_distinct("l_linenumber").alias("s"))


@query("SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS ss, round(stddev_pop(c_acctbal), 4) AS sp, round(var_samp(c_acctbal), 2) AS vs, round(var_pop(c_acctbal), 2) AS vp FROM customer GROUP BY c_mktsegment")
def agg_stddev_var(t):
    return t("customer").groupBy("c_mktsegment").agg(F.round(F.stddev_samp("c_acctbal"), 4).alias("ss"), F.round(F.stddev_pop("c_acctbal"), 4).alias("sp"), F.round(F.var_samp("c_acctbal"), 2).alias("vs"), F.round(F.var_pop("c_acctbal"), 2).alias("vp"))


@query("SELECT l_suppkey, bool_and(l_quantity > 1) AS every, bool_or(l_quantity >= 50) AS some, bit_and(l_linenumber) AS ba, bit_or(l_linenumber) AS bo FROM lineitem GROUP BY l_suppkey")
def agg_bool_bit(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.bool_and(F.col("l_quantity") > 1).alias("every"), F.bool_or(F.col("l_quantity") >= 50).alias("some"), F.bit_and("l_linenumber").alias("ba"), F.bit_or("l_linenumber").alias("bo"))


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey")
def agg_group_concat(t):
    return t("nation").groupBy("n_regionkey").agg(A.group_concat(F.col("n_name"), "|", F.col("n_nationkey"), True).alias("names"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def agg_group_concat_distinct(t):
    return t("part").groupBy("p_brand").agg(A.group_concat(F.col("p_type"), distinct=True).alias("types"))


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_string_agg(t):
    """The order within a group is not fixed, so the parts are sorted to compare them."""
    joined = t("nation").groupBy("n_regionkey").agg(F.listagg("n_name", F.lit("; ")).alias("s"))
    return joined.select("n_regionkey", F.array_join(F.array_sort(F.split("s", "; ")), "; ").alias("names"))


@query(
    "SELECT c_mktsegment, string_agg(v || '=' || n, ',' ORDER BY v) AS histogram FROM (SELECT c_mktsegment, c_nationkey AS v, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY c_mktsegment"
)
def agg_histogram(t):
    h = A.histogram(t("customer"), "c_nationkey", "c_mktsegment")
    return h.select("c_mktsegment", F.array_join(F.transform("histogram", lambda e: F.concat(e["value"].cast("string"), F.lit("="), e["n"].cast("string"))), ",").alias("histogram"))


@query("SELECT p_brand, CAST(greatest(1, least(100, trunc(100 * count(DISTINCT p_size) / count(*)))) AS INTEGER) AS selectivity FROM part GROUP BY p_brand")
def agg_selectivity(t):
    return t("part").groupBy("p_brand").agg(A.selectivity(F.col("p_size")).alias("selectivity"))


@query("SELECT l_returnflag, CAST(sum(l_linenumber) // count(l_linenumber) AS BIGINT) AS whole, CAST(sum(l_orderkey) AS VARCHAR) AS exact FROM lineitem GROUP BY l_returnflag")
def agg_integer_average(t):
    return t("lineitem").groupBy("l_returnflag").agg(A.avg_int(F.col("l_linenumber")).alias("whole"), A.sum_exact(F.col("l_orderkey")).cast("string").alias("exact"))


@query("SELECT o_orderstatus, round(sum(o_totalprice) / count(*) + 1, 4) AS shifted, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderstatus")
def agg_in_expression(t):
    return t("orders").groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice") / F.count("*") + 1, 4).alias("shifted"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def select_distinct(t):
    return A.distinct_rows(t("lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


# Ordering and paging


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t):
    return R.top_k(t("orders"), 10, "o_totalprice desc", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7 OFFSET 20")
def limit_offset(t):
    return R.page(t("orders").orderBy(*R.order("o_totalprice", "o_orderkey")), 7, 20).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer LIMIT 0")
def limit_zero(t):
    return R.page(t("customer").select("c_custkey"), 0)


@query("SELECT c_custkey, v, row_number() OVER (ORDER BY v ASC NULLS FIRST, c_custkey) AS asc_place, row_number() OVER (ORDER BY v DESC NULLS LAST, c_custkey) AS desc_place FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS v FROM customer)")
def order_nulls(t):
    v = t("customer").select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("v"))
    up = numbered(v.withColumn("isnull", F.col("v").isNotNull()), ["isnull", "v", "c_custkey"], "asc_place").drop("isnull")
    return numbered(up.withColumns({"isnull": F.col("v").isNull(), "down": -F.col("v")}), ["isnull", "down", "c_custkey"], "desc_place").select("c_custkey", "v", "asc_place", "desc_place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rownum FROM orders")
def row_number_all(t):
    return numbered(t("orders").select("o_orderkey"), ["o_orderkey"], "rownum")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
def top_k_per_group(t):
    return R.top_k_per_group(t("orders"), ["o_custkey"], 2, "o_totalprice desc", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


# Set operations


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all(t):
    return R.union_all(t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b")), t("supplier").select("s_nationkey", "s_acctbal"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def except_rows(t):
    return R.except_distinct(t("nation").select(F.col("n_nationkey").alias("k")), t("supplier").where("s_acctbal > 8000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def intersect_rows(t):
    return t("customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").where("s_acctbal < 0").select("s_nationkey"))


@query("(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region) INTERSECT SELECT s_nationkey FROM supplier")
def set_left_to_right(t):
    return t("nation").select(F.col("n_nationkey").alias("k")).union(t("region").select(F.col("r_regionkey") + 100)).intersect(t("supplier").select("s_nationkey"))


# Subqueries, common table expressions, views

sql_query("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", None, "orders")
sql_query(
    "correlated_subquery",
    "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.3 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)",
    "SELECT l_orderkey, l_linenumber FROM lineitem l JOIN (SELECT l_partkey AS k, avg(l_quantity) AS a FROM lineitem GROUP BY 1) ON k = l_partkey WHERE l_quantity > 1.3 * a",
    "lineitem",
)


@query("SELECT c_custkey, c_acctbal >= ALL (SELECT s_acctbal FROM supplier) AS all_above, c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_acctbal < 0) AS any_below FROM customer")
def quantified_subqueries(t):
    up = R.quantified(t("customer"), F.col("c_acctbal"), ">=", "ALL", t("supplier").select("s_acctbal"), "all_above")
    return R.quantified(up, F.col("c_acctbal"), "<", "ANY", t("supplier").where("s_acctbal < 0").select("s_acctbal"), "any_below").select("c_custkey", "all_above", "any_below")


@query("SELECT c_custkey, TRUE AS all_of_none, FALSE AS any_of_none FROM customer")
def quantified_empty(t):
    none = t("supplier").where("s_suppkey < 0").select("s_acctbal")
    return R.quantified(R.quantified(t("customer"), F.col("c_acctbal"), ">", "ALL", none, "all_of_none"), F.col("c_acctbal"), ">", "SOME", none, "any_of_none").select("c_custkey", "all_of_none", "any_of_none")


sql_query("cte", "WITH big AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_name, round(s, 2) AS total FROM big JOIN customer ON c_custkey = k WHERE s > 2000000", None, "orders", "customer")
sql_query("recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 18) SELECT n, f FROM r")
sql_query("derived_table", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) d WHERE n >= 15", None, "orders")


@query("SELECT y, n FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) WHERE n > 0")
def view_query(t):
    t("orders").where("o_orderstatus = 'F'").groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count("*").alias("n")).createOrReplaceTempView("orders_per_year")
    return SparkSession.active().sql("SELECT y, n FROM orders_per_year WHERE n > 0")


# Star-schema composites


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, "
    "round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2"
)
def q1(t):
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    r = lambda c, d: F.round(c, d)
    return (
        t("lineitem").where("l_shipdate <= TIMESTAMP_NTZ '2001-09-02'").groupBy("l_returnflag", "l_linestatus")
        .agg(
            r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum("l_extendedprice"), 2).alias("sum_base"), r(F.sum(disc), 2).alias("sum_disc"), r(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            r(F.avg("l_quantity"), 6).alias("avg_qty"), r(F.avg("l_extendedprice"), 6).alias("avg_price"), r(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
        )
    )


@query(
    "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey "
    "WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10"
)
def q3(t):
    o = t("orders").where("o_orderdate < TIMESTAMP_NTZ '1998-03-15'").join(t("customer").where("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"))
    li = t("lineitem").where("l_shipdate > TIMESTAMP_NTZ '1998-03-15'")
    s = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
    return R.top_k(s, 10, "revenue desc", "o_orderkey").select("o_orderkey", "revenue", "o_orderdate")


@query(
    "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'none' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY n_name"
)
def q5(t):
    place = t("nation").join(t("region").where("r_name <> 'none'"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = t("orders").where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01' and o_orderdate < TIMESTAMP_NTZ '1999-01-01'").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    sold = t("lineitem").join(o.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    makers = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    j = sold.join(makers, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24")
def q6(t):
    return t("lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1997-01-01' and l_shipdate < TIMESTAMP_NTZ '1998-01-01' and l_discount between 0.045 and 0.075 and l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))


@query(
    "SELECT c_custkey, c_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey "
    "WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01' GROUP BY 1, 2, 3 ORDER BY revenue DESC, c_custkey LIMIT 20"
)
def q10(t):
    o = t("orders").where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01' and o_orderdate < TIMESTAMP_NTZ '1997-07-01'")
    s = t("lineitem").where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"))
    named = s.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", F.round("s", 4).alias("revenue"))
    return R.top_k(named, 20, "revenue desc", "c_custkey")


@query(
    "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey "
    "WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1998-09-01'"
)
def q14(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    j = t("lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1997-09-01' and l_shipdate < TIMESTAMP_NTZ '1998-09-01'").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.agg(F.round(F.lit(100.0) * F.sum(F.when(F.col("p_type").like("PROMO%"), net).otherwise(0.0)) / F.sum(net), 6).alias("promo"))


@query(
    "SELECT c_name, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey "
    "WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) GROUP BY 1, 2, 3"
)
def q18(t):
    big = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("s")).where("s > 250")
    return big.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_name", "o_orderkey", "o_totalprice", F.round("s", 2).alias("q"))
