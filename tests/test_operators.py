"""Operators on small literal tables, with the results that a relational database gives."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import aggregates as A
from quillon.operators import changes as C
from quillon.operators import relational as R
from quillon.plans.fluent import Query
from quillon.sources import csv, generated, script
from quillon.types import Domain, Enum, spark_type

c = F.col


@pytest.fixture(scope="module")
def kv(spark):
    rows = [("01", "a1", "a", 51), ("02", "a1", "b", 61), ("03", "a1", "c", 61), ("25", "a2", "d", 51), ("26", "a2", "e", 61), ("27", "a2", "f", 61), ("50", "a1", "g", 12), ("51", "a2", "h", 12), ("52", "a1", "i", 12), ("75", "a1", "j", 12), ("76", "a2", "k", 12), ("77", "a1", "l", 12)]
    return spark.createDataFrame(rows, "pk string, f1 string, f2 string, f3 int")


def test_select(kv):
    assert kv.count() == 12 and kv.where("f3 = 12").count() == 6 and kv.where("f1 = 'a2'").count() == 5 and kv.where("pk >= '50' and f1 = 'a2'").count() == 2
    assert kv.agg(F.sum("f3")).first()[0] == 418 and kv.agg(A.avg_int(c("f3"))).first()[0] == 34
    assert R.page(kv.orderBy(*R.order("f2 desc")), 2, 1).first()["f2"] == "k"
    assert R.page(kv, 0).count() == 0 and R.page(kv, -1).count() == 12


def test_joins(spark):
    t1 = spark.createDataFrame([(1, 10, "a1"), (2, 20, "b1"), (3, 30, "a2"), (4, 40, "b2"), (5, 80, "b2")], "pk int, id int, name string")
    t2 = spark.createDataFrame([(1, 60), (2, 70), (3, 80), (4, 90)], "pk2 int, id2 int")
    t4 = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30)], "pk4 int, id int")
    assert t1.join(t2, c("id") == c("id2")).count() == 1 and R.natural_join(t1, t4).count() == 4
    assert R.natural_join(t2, t4).count() == 16 and R.right_join(t2, t1, c("id") == c("id2")).count() == 5


def test_band_join(spark):
    a = spark.createDataFrame([(0.0,), (1.0,), (2.5,), (None,)], "x double")
    b = spark.createDataFrame([(1, 0.0, 1.0), (2, 2.6, 9.0), (3, 5.0, 4.0), (4, -100.0, 100.0)], "k int, lo double, hi double")
    got = {(r["x"], r["k"]) for r in R.band_join(a, b, "x", "lo", "hi", 1.0).collect()}
    assert got == {(0.0, 1), (1.0, 1), (0.0, 4), (1.0, 4), (2.5, 4)}


def test_quantified(spark):
    t = spark.createDataFrame([("01", 10), ("02", 50), ("03", 30), ("04", 40), ("05", 20), ("06", 60)], "pk string, v int")
    s = t.where("pk >= '04'").select("v")
    n = lambda op, q, vals=s: R.quantified(t, c("v"), op, q, vals, "r").where("r").count()
    assert n("<", "ALL") == 1 and n("<", "ANY") == 5 and n("<", "SOME") == 5
    nulls = spark.createDataFrame([(None,), (20,)], "v int")
    truth = {r["v"]: r["r"] for r in R.quantified(t, c("v"), ">", "ALL", nulls, "r").collect()}
    assert truth[10] is False and truth[60] is None
    only = spark.createDataFrame([(None,)], "v int")
    assert R.quantified(t, c("v"), ">", "ANY", only, "r").where("r is null").count() == 6
    same = spark.createDataFrame([(10,), (10,)], "v int")
    assert n("=", "ALL", same) == 1 and n("<>", "ANY", same) == 5


def test_not_in(spark):
    t = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "w int")
    ids = lambda df: sorted((r["v"] for r in df.collect()), key=str)
    assert ids(R.not_in(t, "v", values(1))) == [2] and ids(R.not_in(t, "v", values(1, None))) == [] and len(ids(R.not_in(t, "v", values(1).limit(0)))) == 3


def test_set_operations(spark):
    u1 = spark.createDataFrame([(1, "a1"), (1, "b1"), (2, "a2"), (2, "b2"), (3, "a3"), (3, "b3")], "id int, name string")
    u2 = spark.createDataFrame([(4, "a1"), (4, "b1"), (5, "a2"), (5, "b2"), (6, "a3"), (6, "b3"), (3, "a3"), (3, "b3")], "id int, name string")
    assert u1.union(u2).distinct().count() == 12 and R.union_all(u1, u2).count() == 14 and u1.intersect(u2).count() == 2 and R.except_distinct(u1, u2).count() == 4
    with pytest.raises(ValueError):
        R.union_all(u1, u2.select("id"))


def test_special_aggregates(spark):
    d = spark.createDataFrame([("abc1", 1), ("abc2", 2), ("abc3", 3)] * 2, "name string, f1 int")
    assert [tuple(x) for x in A.histogram(d, "f1").first()["histogram"]] == [(1, 2), (2, 2), (3, 2)]
    r = d.agg(A.selectivity(c("f1")).alias("s"), A.group_concat(c("name"), ",", c("f1"), True, True).alias("g"), F.median("f1").alias("m")).first()
    assert (r["s"], r["g"], r["m"]) == (50, "abc3,abc2,abc1", 2)
    assert d.where("f1 = 1").agg(A.group_concat(c("name"), ",", c("f1"), True).alias("g")).first()["g"] == "abc1,abc1"
    assert d.limit(0).agg(A.selectivity(c("f1")).alias("s"), A.group_concat(c("name")).alias("g")).first().asDict() == {"s": 50, "g": None}


def test_changes(spark):
    t = spark.createDataFrame([(10, "a"), (20, "b"), (None, "n")], "id int, name string")
    new = spark.createDataFrame([(10, "abc"), (30, None), (None, "m")], "id int, name string")
    got = sorted(((r["id"], r["name"]) for r in C.merge(t, new, ["id"]).collect()), key=str)
    assert got == sorted([(10, "abc"), (20, "b"), (30, None), (None, "n"), (None, "m")], key=str)
    with pytest.raises(ValueError):
        C.merge(t, new, [])
    assert C.delete(t, c("id") > 10).count() == 2 and C.delete(t).count() == 0
    assert C.update(t, {"name": F.lit("z")}, c("id") > 10).where("name = 'z'").count() == 1
    assert C.insert(t, spark.createDataFrame([(7,)], "id int"), {"name": F.lit("d")}).where("name = 'd'").count() == 1
    assert C.duplicates(t.union(t), "id").count() == 2
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "c int, p int")
    assert C.orphans(child, ["p"], parent.where("k = 1"), ["k"]).count() == 1
    kept, same = C.referential_delete(parent, c("k") == 1, child, "p", "k")
    assert kept.count() == 2 and same.count() == 3
    assert [x.count() for x in C.referential_delete(parent, c("k") == 1, child, "p", "k", "cascade")] == [1, 2]
    assert C.referential_delete(parent, c("k") == 1, child, "p", "k", "set default", 2)[1].where("p = 2").count() == 2


def test_sources(spark, tmp_path):
    assert generated.system_range(spark, 1, 10).count() == 10 and [r["x"] for r in generated.system_range(spark, 5, 1, -2).collect()] == [5, 3, 1]
    df = spark.createDataFrame([("a;b", None), ('q"r', " x ")], "s string, t string")
    path = f"file://{tmp_path}/csv"
    assert csv.csv_write(df, path, "fieldSeparator=; null=NIL preserveWhitespace=true") == 2
    back = csv.csv_read(spark, path, None, "fieldSeparator=; null=NIL preserveWhitespace=true")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert script.statements("a ';' ; -- x;\n b /* ; */ c;") == ["a ';'", "b  c"]


def test_types(spark):
    assert spark_type("map<int, list<varchar>>").simpleString() == "map<int,array<string>>" and spark_type("decimal(10, 2)").simpleString() == "decimal(10,2)"
    with pytest.raises(ValueError):
        spark_type("NOSUCH")
    e = Enum(["sad", "ok", "happy"])
    r = spark.range(1).select(e.ordinal(F.lit("ok")).alias("o"), e.label(F.lit(3)).alias("l"), e.label(F.lit(4)).alias("n")).first()
    assert (r["o"], r["l"], r["n"]) == (2, "happy", None)
    with pytest.raises(Exception, match="no such label"):
        spark.range(1).select(e.checked(F.concat(F.lit("b"), c("id").cast("string")))).collect()
    d = Domain(spark_type("INT"), 7, lambda x: x > 0)
    assert spark.range(1).select(d.apply(F.lit(None)).alias("x")).first()["x"] == 7


def test_fluent(kv):
    q = Query(kv)["f1"].eq("a2").and_().lp()["f3"].eq(12).or_()["f2"].isin("d").rp()
    assert q.find_count() == 3
    assert Query(kv).not_()["f1"].eq("a2").find_count() == 7
    assert Query(kv)["f2"].desc().limit(2).find_list()[0]["f2"] == "l"
    assert Query(kv)["f3"].eq(12).update(f2="z").where("f2 = 'z'").count() == 6 and Query(kv)["f3"].eq(12).delete().count() == 6


def test_definitions(spark):
    from quillon.operators import definitions as D

    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    assert D.add_column(t, "n", "INT", 5, before="S").columns == ["k", "n", "s"]
    assert [r["k"] for r in D.change_type(t, "K", "VARCHAR").orderBy("k").collect()] == ["1", "2"]
    for wrong in (
        lambda: D.add_column(t, "K", "INT"), lambda: D.add_column(t, "x", "INT", not_null=True), lambda: D.drop_column(t, "x"), lambda: D.drop_column(t.select("k"), "k"), lambda: D.rename_column(t, "k", "S"),
        lambda: D.add_constraint(t, c("k") > 1), lambda: D.add_constraint(t.union(t), unique=["k"]), lambda: D.add_constraint(t, references=(["k"], t.where("k = 1"), ["k"])),
    ):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(Exception, match="NULL not allowed"):
        D.set_not_null(t, "s").collect()
    assert D.truncate(t).count() == 0 and D.truncate(t).columns == t.columns
    stats = {r["column_name"]: (r["n_rows"], r["n_nulls"], r["selectivity"]) for r in D.analyze(t).collect()}
    assert stats == {"k": (2, 0, 100), "s": (2, 1, 100)} and {r["selectivity"] for r in D.analyze(t.limit(0)).collect()} == {50}


def test_limited_changes(spark):
    t = spark.createDataFrame([(i, i % 2) for i in range(10)], "k int, v int")
    assert sorted(r["k"] for r in C.delete(t, c("v") == 0, 2, ["k"]).collect()) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert sorted(r["k"] for r in C.update(t, {"v": F.lit(7)}, None, 3, ["k"]).where("v = 7").collect()) == [0, 1, 2]
    two = spark.createDataFrame([(1, 5), (1, 6), (77, 1), (77, 2)], "k int, v int")
    with pytest.raises(Exception, match="several rows"):
        C.update_from(t, two, ["k"], ["v"]).collect()
    new = C.update_from(t, two, ["k"], ["v"], c("k") > 1).collect()
    assert {r["k"]: r["v"] for r in new} == {0: 0, 1: 1} | {k: None for k in range(2, 10)}
    last = spark.createDataFrame([(1, 9), (1, 3), (50, 1), (50, 8), (50, 2)], "k int, v int").coalesce(1)
    merged = {r["k"]: r["v"] for r in C.merge(t, last, ["k"]).collect()}
    assert merged[1] == 3 and merged[50] == 2 and len(merged) == 11


def test_places(spark):
    t = spark.range(1000).repartition(7)
    stored = R.row_numbers(spark.createDataFrame([(i,) for i in range(500)], "v int"))
    assert sorted(r["rownum"] for r in stored.collect()) == list(range(1, 501))
    assert [r["id"] for r in R.page(R.order_by(t, "-1"), 3).collect()] == [999, 998, 997] and [r["id"] for r in R.page(R.order_by(t, "-1 desc nulls last"), 1).collect()] == [0]
    with pytest.raises(ValueError):
        R.order_by(t, "2")


def test_wide_bands(spark):
    a = spark.createDataFrame([(float(i),) for i in range(-50, 50)] + [(None,), (1e6,)], "x double")
    rows = [(k, lo, lo + w) for k, (lo, w) in enumerate([(-60.0, 1e9), (0.0, 0.0), (3.5, 0.1), (-7.0, 3.0), (-49.5, 64.0), (10.0, 1.0), (5.0, -1.0), (-1e7, 2e7)])]
    b = spark.createDataFrame(rows, "k int, lo double, hi double")
    got = sorted((r["x"], r["k"]) for r in R.band_join(a, b, "x", "lo", "hi", 1.0).collect())
    points = [float(i) for i in range(-50, 50)] + [1e6]
    assert got == sorted((x, k) for x in points for k, lo, hi in rows if lo <= x <= hi)
    assert R.band_join(a, b.limit(0), "x", "lo", "hi", 1.0).count() == 0


def test_aggregate_by_parts(spark):
    from quillon.functions.user import aggregate_by_parts

    t = spark.createDataFrame([("a", 1), ("a", 5), (None, 3), ("b", 2)], "g string, v int").repartition(3)
    got = aggregate_by_parts(t, ["g"], "v", lambda v: {"s": int(v.sum()), "n": len(v)}, {"s": F.sum, "n": F.sum}, "s bigint, n bigint").collect()
    assert {(r["g"], r["s"], r["n"]) for r in got} == {("a", 6, 2), (None, 3, 1), ("b", 2, 1)}
