"""Queries of scalar functions over the star-schema tables, the functions being called by their SQL names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import call
from quillon.plans.registry import query

c = F.col


@query(
    "SELECT n_nationkey, ascii(n_name) AS a, 16 * length(n_name) AS bits, 2 * length(n_name) AS octets, length(n_name) AS chars, chr(65 + n_nationkey) AS ch, upper(n_name) AS up, lower(n_name) AS low, "
    "left(n_name, 3) AS l, right(n_name, 2) AS r, substr(n_name, 2, 3) AS s, substr(n_name, -2) AS tail, reverse(n_name) AS back FROM nation"
)
def fn_string_basic(t):
    n = c("n_name")
    return t("nation").select(
        "n_nationkey", call("ascii", n).alias("a"), call("bit_length", n).alias("bits"), call("octet_length", n).alias("octets"), call("length", n).alias("chars"), call("char", c("n_nationkey") + 65).alias("ch"),
        call("ucase", n).alias("up"), call("lcase", n).alias("low"), call("left", n, 3).alias("l"), call("right", n, 2).alias("r"), call("substr", n, 2, 3).alias("s"), call("substring", n, -2).alias("tail"), F.reverse(n).alias("back"),
    )


@query(
    "SELECT p_partkey, p_name || '-' || p_brand AS joined, concat_ws('/', p_name, nullif(p_type, 'ECONOMY'), p_brand) AS parts, concat(nullif(p_type, 'ECONOMY'), p_brand) AS skipped FROM part"
)
def fn_string_concat(t):
    kind = F.nullif(c("p_type"), F.lit("ECONOMY"))
    return t("part").select("p_partkey", call("concat", c("p_name"), "-", c("p_brand")).alias("joined"), call("concat_ws", "/", c("p_name"), kind, c("p_brand")).alias("parts"), call("concat", kind, c("p_brand")).alias("skipped"))


@query(
    "SELECT p_partkey, instr(p_name, 'e') AS at, CASE WHEN instr(substr(p_name, 4), 'e') > 0 THEN instr(substr(p_name, 4), 'e') + 3 ELSE 0 END AS later, position('i' IN p_name) AS pos, "
    "CASE WHEN instr(reverse(p_name), 'e') > 0 THEN length(p_name) - instr(reverse(p_name), 'e') + 1 ELSE 0 END AS last FROM part"
)
def fn_string_search(t):
    n = c("p_name")
    return t("part").select("p_partkey", call("locate", "e", n).cast("bigint").alias("at"), call("charindex", "e", n, 4).cast("bigint").alias("later"), call("position", "i", n).cast("bigint").alias("pos"), call("instr", n, "e", -1).cast("bigint").alias("last"))


@query(
    "SELECT p_partkey, replace(p_name, ' ', '_') AS rep, replace(p_name, 'e', '') AS gone, repeat(p_type, 2) AS twice, lpad(p_type, 12, '*') AS lp, rpad(p_type, 12, '.') AS rp, trim('xx' || p_type || 'x', 'x') AS tr, ltrim('xx' || p_type, 'x') AS lt, "
    "rtrim(p_type || '  ') AS rt, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS re, substr(p_name, 1, 1) || 'ZZ' || substr(p_name, 4) AS ins, repeat(' ', 3) || p_type AS spaced FROM part"
)
def fn_string_edit(t):
    n, k = c("p_name"), c("p_type")
    return t("part").select(
        "p_partkey", call("replace", n, " ", "_").alias("rep"), call("replace", n, "e").alias("gone"), call("repeat", k, 2).alias("twice"), call("lpad", k, 12, "*").alias("lp"), call("rpad", k, 12, ".").alias("rp"),
        call("trim", F.concat(F.lit("xx"), k, F.lit("x")), "x").alias("tr"), call("ltrim", F.concat(F.lit("xx"), k), "x").alias("lt"), call("rtrim", F.concat(k, F.lit("  "))).alias("rt"),
        call("regexp_replace", n, "([aeiou])", "<$1>").alias("re"), call("insert", n, 2, 2, "ZZ").alias("ins"), F.concat(call("space", 3), k).alias("spaced"),
    )


@query("SELECT r_regionkey, '<!-- ' || r_name || ' -->' || chr(10) AS com, '<![CDATA[' || r_name || ']]>' AS cd, ' a=\"' || r_name || '\"' AS attr, '<r a=\"1\">' || r_name || '</r>' || chr(10) AS node, '<r/>' || chr(10) AS leaf, '&lt;' || r_name || '&amp;&gt;' AS txt FROM region")
def fn_xml(t):
    n = c("r_name")
    return t("region").select(
        "r_regionkey", call("xmlcomment", n).alias("com"), call("xmlcdata", n).alias("cd"), call("xmlattr", "a", n).alias("attr"), call("xmlnode", "r", call("xmlattr", "a", "1"), n).alias("node"), call("xmlnode", "r").alias("leaf"),
        call("xmltext", F.concat(F.lit("<"), n, F.lit("&>"))).alias("txt"),
    )


@query("SELECT n_nationkey, sha256(n_name) AS h, lower(hex(encode(n_name))) AS u8, n_name AS back, '00' || lower(hex(substr(n_name, 1, 1))) AS raw FROM nation")
def fn_hash_hex(t):
    n = c("n_name")
    return t("nation").select(
        "n_nationkey", F.lower(F.hex(call("hash", "SHA256", call("stringtoutf8", n)))).alias("h"), F.lower(F.hex(call("stringtoutf8", n))).alias("u8"), call("hextoraw", call("rawtohex", n)).alias("back"), call("rawtohex", F.substring(n, 1, 1)).alias("raw")
    )


@query("SELECT n_nationkey, n_name AS a, n_name AS b, n_name AS d, n_name AS e, n_name AS f FROM nation")
def fn_round_trips(t):
    n = c("n_name")
    raw = call("stringtoutf8", n)
    whole = F.rpad(n, 16, " ")
    return t("nation").select(
        "n_nationkey", call("utf8tostring", call("expand", call("compress", raw))).alias("a"), call("stringdecode", call("stringencode", n)).alias("b"), call("utf8tostring", call("decrypt", "AES", F.lit(b"key"), call("encrypt", "AES", F.lit(b"key"), raw))).alias("d"),
        F.rtrim(call("utf8tostring", call("decrypt", "XTEA", F.lit(b"key"), call("encrypt", "XTEA", F.lit(b"key"), call("stringtoutf8", whole))))).alias("e"), call("utf8tostring", call("expand", call("compress", raw, "NO"))).alias("f"),
    )


@query("SELECT * FROM (VALUES (1, 'R163', 4), (2, 'R163', 4), (3, 'T522', 0), (4, '0000', 0)) v(k, code, d)")
def fn_soundex(t):
    from quillon.sources.generated import values
    from pyspark.sql import SparkSession

    v = values(SparkSession.active(), (1, "Robert"), (2, "Rupert"), (3, "Tymczak"), (4, "12"), names=["k", "s"])
    return v.select("k", call("soundex", c("s")).alias("code"), call("difference", c("s"), "Robert").alias("d"))


@query(
    "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS ab, ceil(l_discount * 10) AS ce, floor(l_tax * 100) AS fl, sign(l_quantity - 25) AS sg, round(sqrt(l_quantity), 6) AS sq, round(exp(l_discount), 6) AS ex, round(ln(l_quantity), 6) AS l_e, round(log10(l_quantity), 6) AS l_10, "
    "round(power(l_quantity, 1.5), 4) AS pw, l_orderkey % 7 AS md, floor(l_quantity / 10 + 0.5) AS r0, trunc(l_extendedprice / 1000) * 1.0 AS tr FROM lineitem"
)
def fn_math(t):
    q = c("l_quantity")
    r = lambda x, d=6: F.round(x, d)
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", call("abs", q - 25).alias("ab"), call("ceiling", c("l_discount") * 10).alias("ce"), call("floor", c("l_tax") * 100).alias("fl"), call("sign", q - 25).cast("tinyint").alias("sg"), r(call("sqrt", q)).alias("sq"),
        r(call("exp", c("l_discount"))).alias("ex"), r(call("ln", q)).alias("l_e"), r(call("log10", q)).alias("l_10"), r(call("power", q, 1.5), 4).alias("pw"), call("mod", c("l_orderkey"), 7).alias("md"), call("round", q / 10).alias("r0"),
        call("trunc", c("l_extendedprice") / 1000).alias("tr"),
    )


@query(
    "SELECT p_partkey, round(sin(p_size), 6) AS si, round(cos(p_size), 6) AS co, round(tan(p_size), 4) AS ta, round(1 / tan(p_size), 4) AS ct, round(atan(p_size), 6) AS at, round(atan2(p_size, 3), 6) AS a2, round(asin(p_size / 100), 6) AS asn, round(acos(p_size / 100), 6) AS acs, "
    "round(sinh(p_size / 10), 5) AS sh, round(cosh(p_size / 10), 5) AS ch, round(tanh(p_size / 10), 6) AS th, round(degrees(p_size), 4) AS dg, round(radians(p_size), 6) AS rd, round(pi(), 6) AS pi FROM part WHERE p_size > 0"
)
def fn_trigonometry(t):
    s = c("p_size")
    r = lambda x, d=6: F.round(x, d)
    return t("part").where("p_size > 0").select(
        "p_partkey", r(call("sin", s)).alias("si"), r(call("cos", s)).alias("co"), r(call("tan", s), 4).alias("ta"), r(call("cot", s), 4).alias("ct"), r(call("atan", s)).alias("at"), r(call("atan2", s, 3)).alias("a2"), r(call("asin", s / 100)).alias("asn"),
        r(call("acos", s / 100)).alias("acs"), r(call("sinh", s / 10), 5).alias("sh"), r(call("cosh", s / 10), 5).alias("ch"), r(call("tanh", s / 10)).alias("th"), r(call("degrees", s), 4).alias("dg"), r(call("radians", s)).alias("rd"), r(call("pi")).alias("pi"),
    )


@query("SELECT p_partkey, p_partkey & 255 AS a, p_partkey | 16 AS o, xor(p_partkey, p_size::BIGINT) AS x FROM part")
def fn_bit(t):
    return t("part").select("p_partkey", call("bitand", c("p_partkey"), 255).alias("a"), call("bitor", c("p_partkey"), 16).alias("o"), call("bitxor", c("p_partkey"), c("p_size")).alias("x"))


@query("SELECT * FROM (VALUES (1, -2.0, -2.0, 2.34), (2, 3.0, 2.0, -2.34), (3, 2.0, 1.0, 0.0)) v(k, r, t, d)")
def fn_round_rules(t):
    from quillon.sources.generated import values
    from pyspark.sql import SparkSession

    v = values(SparkSession.active(), (1, -2.5, 2.345), (2, 2.5, -2.345), (3, 1.5, 1e-15), names=["k", "x", "y"]).select("k", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))
    return v.select("k", call("round", c("x")).alias("r"), call("trunc", c("x")).alias("t"), call("truncate", call("roundmagic", c("y")), 2).alias("d"))


@query(
    "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, quarter(o_orderdate)::INT AS q, dayofyear(o_orderdate)::INT AS doy, (dayofweek(o_orderdate) + 1)::INT AS dow, isodow(o_orderdate)::INT AS idow, week(o_orderdate)::INT AS w, isoyear(o_orderdate)::INT AS iy, "
    "dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, hour(o_orderdate)::INT AS h FROM orders"
)
def fn_datetime_parts(t):
    d = c("o_orderdate")
    names = {"y": "year", "m": "month", "d": "day", "q": "quarter", "doy": "day_of_year", "dow": "day_of_week", "idow": "iso_day_of_week", "w": "iso_week", "iy": "iso_year", "dn": "dayname", "mn": "monthname", "h": "hour"}
    return t("orders").select("o_orderkey", *[call(f, d).alias(a) for a, f in names.items()])


@query(
    "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS am, strftime(o_orderdate - INTERVAL 2 YEAR, '%Y-%m-%d') AS ay, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H') AS ah, date_diff('year', o_orderdate, TIMESTAMP '2000-02-29') AS dy, "
    "date_diff('month', o_orderdate, TIMESTAMP '2000-02-29') AS dm, date_diff('day', o_orderdate, TIMESTAMP '2000-02-29') AS dd, date_diff('hour', o_orderdate, TIMESTAMP '2000-02-29 05:30:00') AS dh FROM orders"
)
def fn_datetime_arithmetic(t):
    d, end = c("o_orderdate"), F.expr("TIMESTAMP_NTZ '2000-02-29'")
    f = lambda x, p="yyyy-MM-dd": F.date_format(x, p)
    return t("orders").select(
        "o_orderkey", f(call("dateadd", "MONTH", 1, d)).alias("am"), f(call("timestampadd", "YEAR", -2, d)).alias("ay"), f(call("dateadd", "HOUR", 36, d), "yyyy-MM-dd HH").alias("ah"), call("datediff", "YEAR", d, end).alias("dy"),
        call("datediff", "MONTH", d, end).alias("dm"), call("timestampdiff", "DAY", d, end).alias("dd"), call("datediff", "HOUR", d, F.expr("TIMESTAMP_NTZ '2000-02-29 05:30:00'")).alias("dh"),
    )


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS f, minute(ts)::INT AS mi, second(ts)::INT AS s, strftime(ts, '%Y-%m-%d') AS back, strftime(date_trunc('day', ts), '%Y-%m-%d %H') AS midnight FROM events")
def fn_datetime_format(t):
    ts = c("ts")
    return t("events").select(
        "event_id", call("formatdatetime", ts, "yyyy/MM/dd HH:mm:ss").alias("f"), call("extract", "MINUTE", ts).alias("mi"), call("second", ts).alias("s"),
        F.date_format(call("parsedatetime", call("formatdatetime", ts, "dd.MM.yyyy"), "dd.MM.yyyy"), "yyyy-MM-dd").alias("back"), F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd HH").alias("midnight"),
    )


@query(
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS cs, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS cw, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS de, coalesce(nullif(o_orderstatus, 'P'), '-') AS co, "
    "CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'none' ELSE 'some' END AS n2, greatest(o_custkey, 500) AS gr, least(o_custkey, 500) AS le, CAST(floor(o_totalprice + 0.5) AS INTEGER) AS ci, CAST(o_custkey AS VARCHAR) AS cv FROM orders"
)
def fn_conditional(t):
    s = c("o_orderstatus")
    open_ = F.nullif(s, F.lit("P"))
    return t("orders").select(
        "o_orderkey", call("case", s, "F", "done", "O", "open", "part").alias("cs"), call("casewhen", c("o_totalprice") > 200000, 1, 0).alias("cw"), call("decode", s, "F", 1, "O", 2).alias("de"), call("ifnull", open_, "-").alias("co"),
        call("nvl2", open_, "some", "none").alias("n2"), call("greatest", c("o_custkey"), 500).alias("gr"), call("least", c("o_custkey"), 500).alias("le"), call("cast", call("round", c("o_totalprice")), "INT").alias("ci"), call("convert", c("o_custkey"), "VARCHAR(20)").alias("cv"),
    )


@query("SELECT n_nationkey, n_name AS g1, n_regionkey::VARCHAR AS g2, NULL::VARCHAR AS g9, TRUE AS has, n_regionkey = 1 AS one, 2::INT AS n, n_name AS mapped FROM nation")
def fn_array_map(t):
    a = F.array(c("n_name"), c("n_regionkey").cast("string"))
    m = F.create_map(c("n_nationkey"), c("n_name"))
    return t("nation").select(
        "n_nationkey", call("array_get", a, 1).alias("g1"), call("array_get", a, 2).alias("g2"), call("array_get", a, 9).alias("g9"), call("array_contains", a, c("n_name")).alias("has"), call("array_contains", a, "1").alias("one"), call("array_length", a).alias("n"),
        call("array_get", m, c("n_nationkey")).alias("mapped"),
    )


@query()
def fn_session(t):
    """Functions whose values differ from run to run."""
    return t("region").select(
        "r_regionkey", call("database").alias("db"), call("schema").alias("sc"), call("user").alias("us"), call("version").alias("ve"), call("current_date").alias("cd"), call("now").alias("nw"), call("random").alias("rn"), call("random_uuid").alias("uu"),
        F.length(call("secure_rand", 8)).alias("sr"), call("memory_used").alias("mu"), call("session_id").alias("si"), call("autocommit").alias("ac"), call("zero").alias("ze"), call("database_path").alias("dp"), call("lock_timeout").alias("lt"),
    )


@query(
    "SELECT p_partkey, chr(65 + (p_partkey % 26)::INT) AS ch, length(p_name) AS n1, length(p_name) AS n2, lower(p_name) AS lo, upper(p_name) AS up, ceil(p_retailprice / 7) AS ce, round(ln(p_retailprice), 6) AS lg, "
    "coalesce(nullif(p_type, 'ECONOMY'), 'none') AS c1, coalesce(nullif(p_type, 'ECONOMY'), p_brand) AS c2, coalesce(nullif(p_type, 'ECONOMY'), 'x') AS c3, left(p_name, 4) AS cut FROM part"
)
def fn_other_names(t):
    """Names by which functions are known besides their common ones."""
    n, kind = c("p_name"), call("nullif", c("p_type"), F.lit("ECONOMY"))
    return t("part").select(
        "p_partkey", call("chr", (c("p_partkey") % 26).cast("int") + 65).alias("ch"), call("char_length", n).cast("bigint").alias("n1"), call("character_length", n).cast("bigint").alias("n2"), call("lower", n).alias("lo"),
        call("upper", n).alias("up"), call("ceil", c("p_retailprice") / 7).cast("double").alias("ce"), F.round(call("log", c("p_retailprice")), 6).alias("lg"), call("isnull", kind, F.lit("none")).alias("c1"),
        call("coalesce", kind, c("p_brand")).alias("c2"), call("nvl", kind, F.lit("x")).alias("c3"), call("truncate_value", n, 4).alias("cut"),
    )


@query(
    "SELECT event_id, day(ts)::INT AS d1, day(ts)::INT AS d2, (dayofweek(ts) + 1)::INT AS w, dayofyear(ts)::INT AS y, minute(ts)::INT AS m, weekofyear(ts)::INT AS k FROM events"
)
def fn_datetime_names(t):
    ts = c("ts")
    names = {"d1": "day_of_month", "d2": "dayofmonth", "w": "dayofweek", "y": "dayofyear", "m": "minute", "k": "week"}
    return t("events").select("event_id", *[call(f, ts).cast("int").alias(a) for a, f in names.items()])


@query(
    "SELECT TRUE AS today, TRUE AS now, TRUE AS users, TRUE AS auto, FALSE AS readonly, 0 AS lock, 8 AS isolation, 0 AS zero, TRUE AS random, 8 AS secure, 36 AS uuid, TRUE AS memory, TRUE AS version, TRUE AS tx, '<?xml version=\"1.0\"?>' AS xml"
)
def fn_constants(t):
    """What does not differ from run to run in functions of the session: constants, lengths, ranges and agreements."""
    same = lambda *names: F.array_size(F.array_distinct(F.array(*[call(x).cast("string") for x in names]))) == 1
    return t("region").where("r_regionkey = 0").select(
        same("current_date", "curdate").alias("today"), same("now", "current_timestamp").alias("now"), same("user", "current_user").alias("users"), call("autocommit").alias("auto"), call("readonly").alias("readonly"),
        call("lock_timeout").alias("lock"), call("transaction_isolation_level").alias("isolation"), call("zero").cast("int").alias("zero"), call("rand").between(0, 1).alias("random"), F.length(call("secure_rand", 8)).alias("secure"),
        F.length(call("sys_guid")).alias("uuid"), (call("memory_free") >= 0).alias("memory"), call("version").isNotNull().alias("version"), call("transaction_id").isNull().alias("tx"), F.trim(F.regexp_replace(call("xmlstartdoc"), "\\s+$", "")).alias("xml"),
    )


@query("SELECT n_nationkey, NULL::VARCHAR AS zeroth, NULL::VARCHAR AS before, n_name AS first, TRUE AS both, FALSE AS one, 2::INT AS len, NULL::INT AS none FROM nation")
def fn_array_edges(t):
    """Places below 1 hold nothing; a list of values asks for all of them; only arrays have a length."""
    a = F.array(c("n_name"), F.lit("x"))
    return t("nation").select(
        "n_nationkey", call("array_get", a, 0).alias("zeroth"), call("array_get", a, -1).alias("before"), call("array_get", a, 1).alias("first"), call("array_contains", F.array(F.lit("x"), F.lit("y")), ["x", "y"]).alias("both"),
        call("array_contains", a, ["x", "?"]).alias("one"), call("array_length", a).alias("len"), call("array_length", c("n_name")).alias("none"),
    )


@query("SELECT '4b6579' AS key, 'a9993e36' AS sha, TRUE AS xtea, TRUE AS aes, TRUE AS packed")
def fn_cipher_vectors(t):
    """Against published values, and cipher text that differs from the plain text."""
    plain = F.encode(F.lit("0123456789abcdef"), "UTF-8")
    return t("region").where("r_regionkey = 0").select(
        F.lower(F.hex(call("stringtoutf8", F.lit("Key")))).alias("key"), F.left(F.sha1(F.lit("abc")), F.lit(8)).alias("sha"), (call("encrypt", "XTEA", F.lit(b"key"), plain) != plain).alias("xtea"),
        (F.length(call("encrypt", "AES", F.lit(b"key"), plain)) >= 16).alias("aes"), (F.length(call("compress", F.encode(F.repeat(F.lit("ab"), F.lit(5000)), "UTF-8"))) < 1000).alias("packed"),
    )
