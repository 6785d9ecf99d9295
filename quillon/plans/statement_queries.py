"""Queries of table definitions, limited changes, paging forms, sequences, CSV options and further builder methods."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.functions import call, user
from quillon.operators import aggregates as A
from quillon.operators import changes as C
from quillon.operators import definitions as D
from quillon.operators import relational as R
from quillon.operators.sequences import SEQUENCES, numbered
from quillon.operators.statements import Prepared
from quillon.plans.fluent import Query
from quillon.plans.other_queries import scratch
from quillon.plans.registry import query
from quillon.sources import csv, files, metadata, script
from quillon.types import create_domain

c = F.col


# Membership


@query("SELECT c_custkey, c_nationkey = ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS poor, c_nationkey <> ALL (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS other FROM customer")
def quantified_membership(t):
    few = t("supplier").where("s_acctbal < 0").select("s_nationkey")
    some = R.quantified(t("customer"), c("c_nationkey"), "=", "ANY", few, "poor")
    return R.quantified(some, c("c_nationkey"), "<>", "ALL", few, "other").select("c_custkey", "poor", "other")


@query("SELECT n_nationkey, nullif(n_regionkey, 0) = ANY (SELECT nullif(r_regionkey, 1) FROM region WHERE r_regionkey < 3) AS hit, nullif(n_regionkey, 0) <> ALL (SELECT nullif(r_regionkey, 1) FROM region WHERE r_regionkey < 3) AS miss FROM nation")
def quantified_membership_nulls(t):
    values = t("region").where("r_regionkey < 3").select(F.nullif("r_regionkey", F.lit(1)).alias("v"))
    left = F.nullif(c("n_regionkey"), F.lit(0))
    return R.quantified(R.quantified(t("nation"), left, "=", "SOME", values, "hit"), left, "<>", "ALL", values, "miss").select("n_nationkey", "hit", "miss")


# Limited changes


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000 ORDER BY s_suppkey LIMIT 15)")
def dml_delete_limit(t):
    return C.delete(t("supplier"), c("s_acctbal") < 2000, 15, ["s_suppkey"]).select("s_suppkey")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 40) THEN 'FIRST' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update_limit(t):
    return C.update(t("customer").select("c_custkey", "c_mktsegment"), {"c_mktsegment": F.lit("FIRST")}, c("c_mktsegment") == "BUILDING", 40, ["c_custkey"])


@query(
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN n ELSE 0 END AS n, CASE WHEN c_mktsegment = 'BUILDING' THEN latest ELSE NULL END AS latest "
    "FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"
)
def dml_update_row_subquery(t):
    """UPDATE ... SET (n, latest) = (subquery for each customer)."""
    table = t("customer").select("c_custkey", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("latest"), "c_mktsegment")
    rows = t("orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("latest"))
    return C.update_from(table, rows, ["c_custkey"], ["n", "latest"], c("c_mktsegment") == "BUILDING").drop("c_mktsegment")


@query("SELECT c_custkey, coalesce((SELECT arg_max(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey), c_mktsegment) AS c_mktsegment FROM customer")
def dml_merge_last(t):
    """Of several rows with one key the last by order key counts."""
    new = t("orders").select(c("o_custkey").alias("c_custkey"), c("o_orderstatus").alias("c_mktsegment"), "o_orderkey")
    known = new.join(t("customer").select("c_custkey"), "c_custkey", "left_semi")
    return C.merge(t("customer").select("c_custkey", "c_mktsegment"), known.select("c_custkey", "c_mktsegment", "o_orderkey"), ["c_custkey"], c("o_orderkey")).select("c_custkey", "c_mktsegment")


# Definitions


@query("SELECT n_nationkey, 'none' AS motto, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def ddl_alter_columns(t):
    """Added before another, dropped, renamed and converted columns."""
    added = D.add_column(D.add_column(t("nation").select("n_nationkey", "n_name", "n_regionkey"), "motto", "VARCHAR", "none", before="n_name"), "gone", "INT", 0)
    return D.change_type(D.rename_column(D.rename_column(D.drop_column(added, "GONE"), "n_name", "name"), "N_REGIONKEY", "region"), "region", "VARCHAR")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def ddl_constraints(t):
    """Constraints that hold: a check, a unique key and a reference; rows that broke one would raise."""
    s = D.add_constraint(t("supplier"), c("s_acctbal") > -1e6, ["s_suppkey"], (["s_nationkey"], t("nation"), ["n_nationkey"]))
    return D.set_not_null(s, "s_suppkey").join(t("nation"), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")


@query("SELECT p_partkey, coalesce(nullif(p_size, 7), 99) AS size FROM part")
def ddl_domain(t):
    """A domain with a default for null and a check."""
    size = create_domain("size_or_99", "INT", 99, lambda v: v >= 0)
    return t("part").select("p_partkey", size.apply(F.nullif(c("p_size"), F.lit(7))).alias("size"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 * 3")
def ddl_constant(t):
    constants = D.Constants(SparkSession.active())
    constants.create("dear", "100000 * 3")
    return t("orders").where(c("o_totalprice") > constants["dear"]).select("o_orderkey")


@query("SELECT 'region of the world' AS text, 5 AS n, 0 AS after")
def ddl_comment_truncate(t):
    """A comment on a stored table read back, and the table's rows before and after TRUNCATE."""
    s = SparkSession.active()
    path = scratch("commented")
    t("region").write.parquet(path)
    s.sql("DROP TABLE IF EXISTS quillon_commented")
    s.sql(f"CREATE TABLE quillon_commented USING parquet LOCATION '{path}'")
    D.comment_on_table(s, "quillon_commented", "region of the world")
    text = s.sql("DESCRIBE TABLE EXTENDED quillon_commented").where("col_name = 'Comment'").first()["data_type"]
    s.sql("DROP TABLE quillon_commented")
    rows = s.read.parquet(path)
    return rows.agg(F.lit(text).alias("text"), F.count("*").cast("int").alias("n")).join(D.truncate(rows).agg(F.count("*").cast("int").alias("after")))


@query(
    "SELECT * FROM (SELECT 'n_nationkey' AS column_name, count(*) AS n_rows, 0 AS n_nulls, 100 AS selectivity FROM nation UNION ALL SELECT 'n_name', count(*), 0, 100 * count(DISTINCT n_name) // count(*) FROM nation "
    "UNION ALL SELECT 'n_regionkey', count(*), 0, 100 * count(DISTINCT n_regionkey) // count(*) FROM nation)"
)
def ddl_analyze(t):
    return D.analyze(t("nation").select("n_nationkey", "n_name", "n_regionkey")).select("column_name", "n_rows", c("n_nulls").cast("bigint").alias("n_nulls"), c("selectivity").cast("bigint").alias("selectivity"))


# Ordering and paging


@query("SELECT p_brand, p_partkey FROM part ORDER BY p_brand DESC, p_partkey LIMIT 20")
def order_by_ordinals(t):
    """ORDER BY -1, 2: a negative place sorts downwards."""
    return R.page(R.order_by(t("part").select("p_brand", "p_partkey"), "-1", "2"), 20)


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey OFFSET 7 ROWS FETCH FIRST 12 ROWS ONLY")
def offset_fetch(t):
    return R.page(R.order_by(t("customer").select("c_custkey", "c_acctbal"), "2 desc", "c_custkey"), 12, 7).select("c_custkey")


@query("SELECT count(*) AS n, bool_and(o_orderkey IS NOT NULL) AS known FROM (SELECT o_orderkey FROM orders LIMIT 100)")
def sample_size(t):
    """SAMPLE_SIZE 100: which rows are read is not fixed, how many are is."""
    return A.sampled(t("orders"), 100).agg(F.count("*").alias("n"), F.bool_and(c("o_orderkey").isNotNull()).alias("known"))


@query("SELECT k FROM (SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 2 UNION ALL SELECT r_regionkey + 100 FROM region) ORDER BY k DESC LIMIT 6")
def set_operation_page(t):
    """ORDER BY and LIMIT on a whole set operation, of which one side is wider."""
    both = R.union_all(t("nation").where("n_regionkey < 2").select(c("n_nationkey").cast("int").alias("k")), t("region").select((c("r_regionkey") + 100).cast("bigint")))
    return R.top_k(both, 6, "k desc").select(c("k").cast("int").alias("k"))


@query("SELECT count(*) AS n, min(rownum) AS least, max(rownum) AS most, CAST(sum(rownum) AS BIGINT) AS total, count(DISTINCT rownum) AS different FROM (SELECT row_number() OVER () AS rownum FROM lineitem)")
def rownum_scan(t):
    """ROWNUM in the order in which rows are read."""
    r = R.row_numbers(t("lineitem").select("l_orderkey"))
    return r.agg(F.count("*").alias("n"), F.min("rownum").alias("least"), F.max("rownum").alias("most"), F.sum("rownum").alias("total"), F.count_distinct("rownum").alias("different"))


# Sequences


@query("SELECT row_number() OVER (ORDER BY c_custkey) * 10 + 90 AS id, c_custkey FROM customer")
def sequence_rows(t):
    """A sequence from 100 in steps of 10 for all rows."""
    return numbered(t("customer").select("c_custkey"), ["c_custkey"], "id", 100, 10).select("id", "c_custkey")


@query("SELECT 5 AS a, 7 AS b, 7 AS current, 9 AS c, 5 AS wrapped, 5 AS last")
def sequence_values(t):
    SEQUENCES.held.pop("quillon_s", None)
    SEQUENCES.create("quillon_s", start=5, step=2, least=5, most=9, cycle=True)
    one = t("region").where("r_regionkey = 0")
    return one.select(call("nextval", "quillon_s").alias("a"), call("nextval", "quillon_s").alias("b"), call("currval", "quillon_s").alias("current"), call("nextval", "quillon_s").alias("c"), call("nextval", "QUILLON_S").alias("wrapped"), call("lastval").alias("last"))


# Sources


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, '  ' || p_name || ' ''q'' |x' AS text, nullif(p_type, 'ECONOMY') AS kind FROM part")
def csv_options(t):
    """Another quote and escape, kept white space, a text for null, and a character set."""
    path = scratch("csv-options")
    options = "fieldDelimiter=' fieldSeparator=| escape=\\\\ preserveWhitespace=true null=NIL charset=UTF-16LE"
    csv.csv_write(t("part").select("p_partkey", F.concat(F.lit("  "), c("p_name"), F.lit(" 'q' |x")).alias("text"), F.nullif(c("p_type"), F.lit("ECONOMY")).alias("kind")), path, options)
    return csv.csv_read(SparkSession.active(), path, None, options)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name AS name FROM region")
def csv_comments(t):
    """Named columns without a head line; lines that begin with the comment mark are no rows."""
    path = scratch("csv-comments")
    lines = t("region").select(F.concat_ws(";", "r_regionkey", "r_name").alias("value")).unionByName(t("region").select(F.concat(F.lit("#"), "r_name").alias("value")))
    lines.write.text(path)
    return csv.csv_read(SparkSession.active(), path, ["k", "name"], "fieldSeparator=; lineComment=#")


@query("SELECT string_agg(r_name, ',' ORDER BY r_name) AS content FROM region")
def file_content(t):
    """Whole files as rows, then their lines."""
    path = scratch("files")
    t("region").select("r_name").write.text(path)
    lines = files.files(SparkSession.active(), path).where("path like '%.txt'").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    return lines.agg(F.array_join(F.array_sort(F.collect_list("line")), ",").alias("content"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (10, 11, 12)")
def bucketed_lookup(t):
    """A table stored in buckets of a key, as a hash index would find it."""
    s = SparkSession.active()
    s.sql("DROP TABLE IF EXISTS quillon_bucketed")
    files.write_bucketed(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "quillon_bucketed", 8, "o_custkey", path=scratch("bucketed"))
    return s.table("quillon_bucketed").where(c("o_custkey").isin(10, 11, 12)).select("o_orderkey", "o_totalprice")


@query("SELECT 'spark.app.name' AS name, 1 AS n")
def info_setting(t):
    got = metadata.settings(SparkSession.active())
    name = got.columns[0]
    return got.where(c(name) == "spark.app.name").groupBy(c(name).alias("name")).agg(F.count("*").cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('ARRAY_GET'), ('CONCAT'), ('DATEADD'), ('ROUNDMAGIC')) v(function_name)")
def info_function_names(t):
    return metadata.functions(SparkSession.active()).where(c("function_name").isin("ARRAY_GET", "CONCAT", "DATEADD", "ROUNDMAGIC", "NO_SUCH"))


@query("SELECT TRUE AS ran, TRUE AS staged")
def info_query_statistics(t):
    """The session's jobs: at least the one just run has succeeded, in one stage or more."""
    t("region").count()
    jobs = metadata.query_statistics(SparkSession.active()).where("status = 'SUCCEEDED'")
    return jobs.agg((F.count("*") > 0).alias("ran"), (F.max("stages") > 0).alias("staged"))


@query("SELECT 'quillon_listed' AS table_name, 'VIEW' AS kind")
def info_views(t):
    t("region").createOrReplaceTempView("quillon_listed")
    rows = metadata.tables(SparkSession.active()).where("table_name = 'quillon_listed'").select("table_name", F.lit("VIEW").alias("kind"))
    return SparkSession.active().createDataFrame(rows.collect(), rows.schema)


@query("SELECT TRUE AS aggregates, TRUE AS scans, TRUE AS pushed")
def explain_parts(t):
    """What EXPLAIN says of a filtered aggregate: it aggregates, it scans, and its filter reaches the scan."""
    t("orders").createOrReplaceTempView("orders")
    text = SparkSession.active().sql("EXPLAIN FORMATTED SELECT o_custkey, count(*) FROM orders WHERE o_custkey = 5 GROUP BY o_custkey").agg(F.array_join(F.collect_list("plan"), "\n").alias("p"))
    return text.select(F.contains("p", F.lit("HashAggregate")).alias("aggregates"), F.contains("p", F.lit("Scan parquet")).alias("scans"), F.col("p").rlike(r"PushedFilters: \[[^\]]*EqualTo\(o_custkey,5\)").alias("pushed"))


# Statements


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 1000 AND s_nationkey = 3 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000 AND s_nationkey = 7")
def prepared_statements(t):
    """Prepared once, executed with values, and deallocated; by place and by name."""
    t("supplier").createOrReplaceTempView("supplier")
    p = Prepared(SparkSession.active())
    p.prepare("RICH", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > ?2 AND s_nationkey = ?1")
    p.prepare("named", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > :least AND s_nationkey = :nation")
    both = p.execute("rich", 3, 1000).unionByName(p.execute("named", least=5000, nation=7))
    p.deallocate("rich")
    return both


@query("SELECT upper('abc') || 7 AS result")
def call_expression(t):
    """CALL evaluates an expression without a table."""
    return SparkSession.active().range(1).select(F.concat(call("ucase", F.lit("abc")), F.lit(3 + 4).cast("string")).alias("result"))


@query("SELECT r_regionkey, 'AB' AS x, TRUE AS stamp, 'café' AS n FROM region")
def literals_typed(t):
    """Binary literals, a time of day within a timestamp, and national text."""
    stamp = F.expr("date_format(TIMESTAMP_NTZ '2020-01-01 12:34:56', 'HH:mm:ss') = '12:34:56'")
    return t("region").select("r_regionkey", F.expr("cast(X'4142' as string)").alias("x"), stamp.alias("stamp"), F.lit("café").alias("n"))


@query("SELECT n_regionkey AS place, count(*) AS many FROM nation WHERE n_regionkey < 4 GROUP BY 1")
def view_columns(t):
    """A view with column names of its own, replaced and dropped."""
    s = SparkSession.active()
    t("nation").createOrReplaceTempView("nation")
    s.sql("CREATE OR REPLACE TEMPORARY VIEW quillon_v (place, many) AS SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey")
    s.sql("CREATE OR REPLACE TEMPORARY VIEW quillon_v (place, many) AS SELECT n_regionkey, count(*) FROM nation WHERE n_regionkey < 4 GROUP BY n_regionkey")
    rows = s.table("quillon_v").select("place", "many")
    s.catalog.dropTempView("quillon_v")
    return rows


@query("SELECT 5 AS n, 'quillon_other' AS place")
def ddl_schema(t):
    """A schema made, used for a stored table, and dropped with it."""
    s = SparkSession.active()
    path = scratch("schema")
    t("region").write.parquet(path)
    s.sql("CREATE SCHEMA IF NOT EXISTS quillon_other")
    s.sql("DROP TABLE IF EXISTS quillon_other.region")
    s.sql(f"CREATE TABLE quillon_other.region USING parquet LOCATION '{path}'")
    n, place = s.table("quillon_other.region").count(), s.catalog.getTable("quillon_other.region").namespace[0]
    s.sql("DROP SCHEMA quillon_other CASCADE")
    return s.range(1).select(F.lit(n).cast("int").alias("n"), F.lit(place).alias("place"))


@query(
    "SELECT 'INSERT INTO r VALUES (' || r_regionkey || ', ''' || r_name || '\\''s'', NULL);' AS statement FROM region "
    "UNION ALL SELECT 'CREATE TABLE r (r_regionkey bigint, name string, x int);'"
)
def script_text(t):
    """The SQL text that makes a table again."""
    r = t("region").select(c("r_regionkey").cast("bigint").alias("r_regionkey"), F.concat("r_name", F.lit("'s")).alias("name"), F.lit(None).cast("int").alias("x"))
    return script.insert_statements(r, "r").unionByName(SparkSession.active().createDataFrame([(script.create_statement(r, "r"),)], "statement string"))


@query("SELECT p_partkey, p_brand || '/' || p_type AS two, p_brand || '/' || p_type || '/' || p_name AS three FROM part")
def udf_varargs(t):
    """One user function of any number of arguments."""
    f = user.create_alias(SparkSession.active(), "slashed", lambda *xs: "/".join(xs), "string", vectorised=False)
    return t("part").select("p_partkey", f("p_brand", "p_type").alias("two"), f("p_brand", "p_type", "p_name").alias("three"))


# The fluent builder


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 100 AND c_acctbal <= 5000 AND c_name LIKE 'Cust%' AND o_orderkey IS NULL")
def fluent_left_join(t):
    q = Query(t("customer")).left_join(t("orders"), c("c_custkey") == c("o_custkey"))
    q = q["c_mktsegment"].ne("BUILDING")["c_acctbal"].ge(100)["c_acctbal"].le(5000)["c_name"].starts_with("Cust")["o_orderkey"].is_null()
    return q.select("c_custkey", "o_orderkey").to_df()


@query("SELECT n_name, r_name FROM region RIGHT JOIN nation ON r_regionkey = n_regionkey AND r_regionkey < 2 WHERE n_nationkey BETWEEN 3 AND 20 AND n_nationkey NOT IN (7, 9) AND (lower(n_name) LIKE '%a' OR lower(n_name) LIKE 'i%' OR lower(n_name) = 'x' OR n_name LIKE '%1')")
def fluent_right_join(t):
    q = Query(t("region")).right_join(t("nation"), (c("r_regionkey") == c("n_regionkey")) & (c("r_regionkey") < 2))
    q = q["n_nationkey"].between(3, 20)["n_nationkey"].not_in(7, 9).lp()["n_name"].iends_with("A").or_()["n_name"].istarts_with("I").or_()["n_name"].ieq("X").or_()["n_name"].ends_with("1").rp()
    return q.select("n_name", "r_name").to_df()


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), split_part(p_name, ' ', 1)) AND NOT list_contains(string_split(p_name, ' '), 'zzz') AND p_type IS NOT NULL AND p_size < 20 AND regexp_matches(p_name, '[aeiou]')")
def fluent_arrays(t):
    words = t("part").withColumn("words", F.split("p_name", " "))
    q = Query(words)["words"].is_not_empty().not_()["words"].contains("zzz", "yyy")["words"].not_contains("zzz")["p_type"].is_not_null()["p_size"].lt(20)["p_name"].match("[aeiou]")
    return q.select("p_partkey").to_df()


@query("SELECT (SELECT count(*) FROM part WHERE p_size > 25) AS n, (SELECT min(p_partkey) FROM part WHERE p_size > 25) AS first, 3 AS listed, (SELECT min(p_partkey) FROM part WHERE p_size > 25) AS in_array")
def fluent_find(t):
    """find_count, find_one, find_list and find_array, each over its own query."""
    q = lambda: Query(t("part"))["p_size"].gt(25)
    ordered = lambda: q()["p_partkey"].asc().select("p_partkey")
    n, first, listed, array = q().find_count(), ordered().find_one()["p_partkey"], len(ordered().limit(3).find_list()), ordered().limit(2).find_array()
    return t("region").where("r_regionkey = 0").select(F.lit(n).cast("bigint").alias("n"), F.lit(first).cast("bigint").alias("first"), F.lit(listed).alias("listed"), F.lit(array[0][0]).cast("bigint").alias("in_array"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey < 5 THEN 'low' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey <> 3 UNION ALL SELECT -1, 'new'")
def fluent_changes(t):
    s = t("supplier").select("s_suppkey", "s_name")
    changed = Query(s)["s_suppkey"].lt(5).update(s_name="low")
    new = SparkSession.active().createDataFrame([(-1, "new")], "s_suppkey long, s_name string")
    return Query(Query(changed)["s_suppkey"].eq(3).delete()).insert(new)
