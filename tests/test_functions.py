"""Functions on literal rows: nulls, empty texts, bounds, month ends, and the known results of fixed dates."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import FUNCTIONS, call


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


CASES = [
    ("ascii", ("",), None), ("ascii", ("A",), 65), ("ascii", ("é",), 233), ("char", (233,), "é"), ("bit_length", ("abc",), 48), ("octet_length", ("abc",), 6), ("concat", (None, "b", None), "b"),
    ("concat", (None, None), None), ("concat_ws", (",", "a", None, "", "b"), "a,b"), ("concat_ws", (",", None, None), ""), ("difference", ("Robert", "Rupert"), 4), ("soundex", ("Tymczak",), "T522"),
    ("soundex", ("123",), "0000"), ("soundex", (None,), None), ("hextoraw", ("00410042",), "AB"), ("rawtohex", ("AB",), "00410042"), ("insert", ("abcdef", 2, 3, "X"), "aXef"), ("insert", ("abc", 9, 1, "X"), "abc"),
    ("insert", ("abc", 2, 9, "X"), "aX"), ("insert", (None, 1, 1, "X"), "X"), ("left", ("abc", -1), ""), ("left", ("abc", 2), "ab"), ("right", ("abc", 2), "bc"), ("right", ("abc", 9), "abc"), ("locate", ("b", "abcb"), 2),
    ("locate", ("b", "abcb", 3), 4), ("locate", ("b", "abcb", -1), 4), ("locate", ("b", "abcb", -2), 2), ("locate", ("z", "abc"), 0), ("locate", ("bc", "abcbc", -1), 4), ("substr", ("abc", -2), "bc"), ("substr", ("abc", -9), "abc"),
    ("substr", ("abc", 0), "abc"), ("substr", ("abc", 2, 1), "b"), ("replace", ("aba", "a"), "b"), ("space", (-1,), ""), ("repeat", ("ab", 2), "abab"), ("stringencode", ('a"\té',), 'a\\"\\t\\u00e9'),
    ("stringdecode", ('a\\"\\t\\u00e9\\101',), 'a"\téA'), ("xmltext", ("<a & b>é",), "&lt;a &amp; b&gt;&#xe9;"), ("xmlnode", ("a", None, "x\ny"), "<a>\n    x\n    y\n</a>\n"), ("xmlnode", ("a",), "<a/>\n"),
    ("xmlcomment", ("a--b",), "<!-- a- -b -->\n"), ("xmlcdata", ("a]]>b",), "a]]&gt;b"), ("round", (-2.5,), -2.0), ("round", (2.345, 1), 2.3), ("trunc", (-2.7,), -2.0), ("ceiling", (1.2,), 2.0), ("floor", (-1.2,), -2.0),
    ("sign", (-3,), -1), ("mod", (-7, 3), -1), ("bitand", (12, 10), 8), ("bitor", (12, 10), 14), ("bitxor", (12, 10), 6), ("roundmagic", (1e-15,), 0.0), ("casewhen", (None, 1, 2), 2), ("nvl2", (None, 1, 2), 2),
    ("decode", (None, None, "null", "other"), "null"), ("decode", (3, 1, "a"), None), ("case", (1, 1, "a", "b"), "a"), ("coalesce", (None, 2), 2), ("greatest", (1, None, 3), 3), ("least", (4, None, 3), 3), ("nullif", (1, 1), None),
    ("truncate_value", ("abcdef", 3), "abc"), ("cast", ("12", "BIGINT"), 12),
]


@pytest.mark.parametrize("name,args,want", CASES)
def test_function(spark, name, args, want):
    if name in ("casewhen",):
        args = (F.lit(None).cast("boolean"), *args[1:])
    assert one(spark, call(name, *args)) == want


def test_every_function_has_a_builder():
    assert len(FUNCTIONS) >= 160 and all(callable(f) for f in FUNCTIONS.values())


def test_dates(spark):
    d = F.expr("TIMESTAMP_NTZ '2012-12-21 11:59:59'")
    want = {"dayname": "Friday", "day_of_month": 21, "day_of_week": 6, "day_of_year": 356, "hour": 11, "minute": 59, "second": 59, "monthname": "December", "quarter": 4, "week": 51, "year": 2012, "iso_year": 2012, "iso_week": 51, "iso_day_of_week": 5}
    got = spark.range(1).select(*[call(f, d).alias(f) for f in want]).first().asDict()
    assert got == want


def test_date_arithmetic(spark):
    ts = lambda s: F.expr(f"TIMESTAMP_NTZ '{s}'")
    text = lambda c: one(spark, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    assert text(call("dateadd", "MONTH", 1, ts("2012-12-21"))) == "2013-01-21 00:00:00"
    assert text(call("dateadd", "MM", 1, ts("2011-01-31"))) == "2011-02-28 00:00:00"
    assert one(spark, call("datediff", "YEAR", ts("2001-01-31"), ts("1999-01-31"))) == -2
    assert one(spark, call("datediff", "MONTH", ts("2001-01-31"), ts("2001-02-01"))) == 1
    assert one(spark, call("datediff", "HOUR", ts("2001-01-31 10:59:00"), ts("2001-01-31 11:01:00"))) == 1
    assert text(call("parsedatetime", "Sat, 3 Feb 2001 03:05:06 GMT", "EEE, d MMM yyyy HH:mm:ss z")) == "2001-02-03 03:05:06"
    assert one(spark, call("formatdatetime", ts("2012-12-21 11:59:59"), "EEE, d MMM yyyy HH:mm:ss")) == "Fri, 21 Dec 2012 11:59:59"
    assert one(spark, call("formatdatetime", F.lit(None).cast("timestamp_ntz"), "yyyy")) is None
    with pytest.raises(ValueError):
        call("dateadd", "FORTNIGHT", 1, ts("2012-12-21"))


def test_errors(spark):
    with pytest.raises(Exception, match="[Dd]ivision|zero"):
        one(spark, call("mod", 1, 0))
    with pytest.raises(Exception, match="zero"):
        one(spark, call("cot", 0.0))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, call("cast", "abc", "INT"))


def test_ciphers(spark):
    for algorithm in ("AES", "XTEA"):
        e = call("encrypt", algorithm, F.lit(b"0123456789abcdef"), F.lit(b"eightbyt"))
        assert bytes(one(spark, call("decrypt", algorithm, F.lit(b"0123456789abcdef"), e))) == b"eightbyt"
    # A published XTEA test vector.
    e = call("encrypt", "XTEA", F.lit(bytes(range(16))), F.lit(b"ABCDEFGH"))
    assert bytes(one(spark, e)).hex() == "497df3d072612cb5"


def test_collections(spark):
    a = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, call("array_get", a, 2)) == "y"
    assert one(spark, call("array_get", a, 3)) is None
    assert one(spark, call("array_contains", a, "y")) is True
    assert one(spark, call("array_length", a)) == 2


def test_sequences():
    from quillon.operators.sequences import Registry

    r = Registry()
    r.create("s", start=5, step=2, most=9)
    assert [r.next("S"), r.next("s"), r.current("s"), r.next("s")] == [5, 7, 7, 9]
    with pytest.raises(ValueError):
        r.next("s")
    r.create("c", start=2, most=2, least=1, cycle=True)
    assert [r.next("c"), r.next("c")] == [2, 1]
