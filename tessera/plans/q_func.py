"""Scalar functions, casts, policies and user-defined functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import dates, expressions, json_path, numbers, strings, udfs
from tessera.functions.policy import PRESTO_STYLE, Policy
from tessera.plans.registry import Block, Tables
from tessera.runtime import deal_by_rows, ship

BLOCK = Block()
query = BLOCK.query


@query("""
SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, CAST(length(p_name) AS INT) AS len, CAST(length(p_brand) AS INT) AS chars, greatest(p_name, p_type) AS most, least(p_name, nullif(p_type, 'PROMO')) AS least_,
  md5(p_name) AS md5_, trim('  ' || p_name || ' ') AS trimmed, left(p_name, 3) AS left_, right(p_name, 4) AS right_, CAST(length(p_name) - length(replace(p_name, 'r', '')) AS BIGINT) AS rs, nullif(replace(p_name, p_name, ''), '') AS e2n FROM part""")
def str_basic(t: Tables):
    """Case, length, extremes, digest, trim, ends, character counts."""
    n, k = F.col("p_name"), F.col("p_type")
    return t.part.select(
        "p_partkey", F.upper(n).alias("up"), F.lower(k).alias("low"), F.length(n).alias("len"), F.char_length("p_brand").alias("chars"), F.greatest(n, k).alias("most"), F.least(n, F.nullif(k, F.lit("PROMO"))).alias("least_"),
        F.md5(n).alias("md5_"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), F.left(n, F.lit(3)).alias("left_"), F.right(n, F.lit(4)).alias("right_"), strings.count_char(n, "r").alias("rs"),
        strings.empty_to_null(F.replace(n, n, F.lit(""))).alias("e2n"),
    )


@query("""
SELECT p_partkey, p_name || '-' || p_type AS cat, concat_ws('|', p_name, nullif(p_type, 'PROMO'), p_brand) AS ws, concat_ws('|', nullif(p_type, p_type)) AS ws_null, rpad(p_brand, 12, ' ') || p_type AS char_cat FROM part""")
def str_concat(t: Tables):
    """Concatenation, with separators, nulls and CHAR operands."""
    n, k = F.col("p_name"), F.col("p_type")
    return t.part.select(
        "p_partkey", F.concat(n, F.lit("-"), k).alias("cat"), F.concat_ws("|", n, F.nullif(k, F.lit("PROMO")), "p_brand").alias("ws"), F.concat_ws("|", F.nullif(k, k)).alias("ws_null"),
        strings.concat_char(F.col("p_brand"), 12, k).alias("char_cat"),
    )


@query("""
SELECT p_partkey, substr(p_name, 2, 3) AS mid, substr(p_name, -3) AS tail, substr(p_name, 1, 2) AS zero, '' AS zero_empty, CASE WHEN length(p_name) < 9 THEN '' ELSE substr(p_name, -9, 4) END AS early,
  replace(p_name, 'ing', 'ed') AS rep, replace(p_name, 'red ', '') AS gone, p_name AS rep_empty FROM part""")
def str_substr(t: Tables):
    """Substrings and replacement, with the variants of the policies."""
    n = F.col("p_name")
    return t.part.select(
        "p_partkey", strings.substr(n, 2, 3).alias("mid"), strings.substr(n, -3).alias("tail"), strings.substr(n, 0, 2).alias("zero"), strings.substr(n, 0, 2, PRESTO_STYLE).alias("zero_empty"),
        strings.substr(n, -9, 4, PRESTO_STYLE).alias("early"), strings.replace(n, "ing", "ed").alias("rep"), strings.replace(n, "red ").alias("gone"), strings.replace(n, "", "*").alias("rep_empty"),
    )


@query("""
SELECT p_partkey, CAST(instr(p_name, 'i') AS INT) AS at, CAST(instr(p_name, '') AS INT) AS at_empty, starts_with(p_name, 'red') AS starts, ends_with(p_name, 'ring') AS ends, contains(p_name, ' ') AS has, p_name LIKE '%ing' AS like_,
  rpad(p_type, 9, ' ') LIKE 'PROMO    ' AS like_char, p_name < p_type AS compare_, p_name = 'red ring' AS equal_ FROM part""")
def str_search(t: Tables):
    """Positions, tests and LIKE, also on CHAR."""
    n, k = F.col("p_name"), F.col("p_type")
    return t.part.select(
        "p_partkey", F.instr(n, "i").alias("at"), F.instr(n, "").alias("at_empty"), n.startswith("red").alias("starts"), n.endswith("ring").alias("ends"), n.contains(" ").alias("has"), n.like("%ing").alias("like_"),
        strings.like_char(k, 9, "PROMO    ").alias("like_char"), (n < k).alias("compare_"), (n == "red ring").alias("equal_"),
    )


@query("""
SELECT p_partkey, regexp_matches(p_brand, '^\\w+#\\d$') AS rlike_, regexp_matches(CAST(p_size AS VARCHAR), '^\\d+$') AS digits, CASE WHEN regexp_matches(p_brand, '#(1\\d)') THEN regexp_extract(p_brand, '#(1\\d)', 1) END AS ext_null,
  regexp_extract(p_brand, '#(\\d+)', 1) AS ext, regexp_replace(p_name, '[aeiou]', '*', 'g') AS rep, CAST(NULL AS VARCHAR) AS no_group FROM part""".replace("\\\\", "\\"))
def str_regex(t: Tables):
    """Regular expressions; extraction that gives null without a match."""
    b = F.col("p_brand")
    return t.part.select(
        "p_partkey", b.rlike(r"^\w+#\d$").alias("rlike_"), F.col("p_size").cast("string").rlike(r"^\d+$").alias("digits"), strings.regexp_extract_null(b, r"#(1\d)").alias("ext_null"), F.regexp_extract(b, r"#(\d+)", 1).alias("ext"),
        F.regexp_replace("p_name", "[aeiou]", "*").alias("rep"), strings.regexp_extract_null(b, r"#(1\d)", 4).alias("no_group"),
    )


@query("""
SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS first, CASE WHEN contains(o_orderpriority, '-') THEN split_part(o_orderpriority, '-', 2) END AS second, CAST(NULL AS VARCHAR) AS none,
  string_split(o_orderpriority, '-')[1] AS before, CASE o_orderpriority WHEN '5-LOW' THEN 'LOW' ELSE split_part(o_orderpriority, '-', 2) END AS after FROM orders""")
def str_split_index(t: Tables):
    """Pieces between separators by index, null out of range, and substring_index."""
    p = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey", strings.split_index(p, "-", 0).alias("first"), strings.split_index(p, "-", 1).alias("second"), strings.split_index(p, "-", 7).alias("none"), F.substring_index(p, "-", 1).alias("before"), F.substring_index(p, "-", -1).alias("after"),
    )


@query("SELECT c_custkey, rpad(c_mktsegment, 12, ' ') AS char_read, rtrim(c_mktsegment) AS varchar_write, rpad(c_mktsegment, 14, ' ') AS char_write FROM customer")
def str_char_varchar(t: Tables):
    """CHAR and VARCHAR checks on read and write."""
    s = F.col("c_mktsegment")
    return t.customer.select("c_custkey", strings.char_pad(s, 12).alias("char_read"), strings.varchar_write_check(F.concat(s, F.lit("")), 10).alias("varchar_write"), strings.char_write_check(s, 14).alias("char_write"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_get(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("none"))


def _json_texts(t: Tables):
    """A JSON text ``j`` for each event, and one that is no JSON, ``cut``.  Tasks get even shares of the events: row groups of
    a million make few splits of a scan, and most of the work is still to come."""
    j = F.concat(F.lit('{"a": {"b": [1, "x", null]}, "n": '), (F.col("event_id") % 7).cast("string"), F.lit(', "s": "t"}'))
    dealt = deal_by_rows(t.events.select("event_id"), t.events.count(), "event_id", at_least=t.spark.sparkContext.defaultParallelism)
    return dealt.select("event_id", j.alias("j")).withColumn("cut", F.concat(F.lit("{"), "j"))


@query("""
WITH j AS (SELECT event_id, '{"a": {"b": [1, "x", null]}, "n": ' || CAST(event_id % 7 AS VARCHAR) || ', "s": "t"}' AS j FROM events)
SELECT event_id, json_extract_string(j, '$.n') AS n, json_extract_string(j, '$.a.b[1]') AS x, CAST(NULL AS VARCHAR) AS object_, CAST(NULL AS VARCHAR) AS null_, 'none' AS default_, 'bad' AS error_ FROM j""")
def json_value(t: Tables):
    """Scalars by path; objects, arrays and nulls count as empty, other text as an error."""
    e, at = json_path.look_up(_json_texts(t), "j", "$.n", '$["a"]["b"][1]', "$.a", "$.a.b[2]", "$.a.b[7]")
    e, bad = json_path.look_up(e, "cut", "$.n")

    def v(path):
        return json_path.json_value(F.col("j"), path, at[path])

    return e.select(
        "event_id", v("$.n").alias("n"), v('$["a"]["b"][1]').alias("x"), v("$.a").alias("object_"), v("$.a.b[2]").alias("null_"),
        json_path.json_value_on(F.col("j"), "$.a.b[7]", "DEFAULT", "NULL", "none", found=at["$.a.b[7]"]).alias("default_"), json_path.json_value_on(F.col("cut"), "$.n", "NULL", "DEFAULT", None, "bad", bad["$.n"]).alias("error_"),
    )


@query("""
SELECT event_id, '{"b":[1,"x",null]}' AS object_, '[1,"x",null]' AS array_, CAST(NULL AS VARCHAR) AS scalar, '["t"]' AS wrapped, '[' || CAST(event_id % 7 AS VARCHAR) || ']' AS number, '[[1,"x",null]]' AS always, '[1,"x",null]' AS conditional,
  '[]' AS empty_, '{}' AS strict_, '[]' AS bad FROM events""")
def json_query(t: Tables):
    """Objects and arrays by path, wrappers, and the lax and strict behaviours."""
    e, at = json_path.look_up(_json_texts(t), "j", "$.a", "$.a.b", "$.s", "$.n", "$.none")
    e, bad = json_path.look_up(e, "cut", "$.a")

    def q(path, *arguments, **behaviours):
        return json_path.json_query(F.col("j"), path, *arguments, **behaviours, found=at[path.removeprefix("strict ")])

    return e.select(
        "event_id", q("$.a").alias("object_"), q("$.a.b").alias("array_"), q("$.s").alias("scalar"), q("$.s", "CONDITIONAL").alias("wrapped"), q("$.n", "UNCONDITIONAL").alias("number"),
        q("$.a.b", "UNCONDITIONAL").alias("always"), q("$.a.b", "CONDITIONAL").alias("conditional"), q("$.none", on_empty="EMPTY ARRAY").alias("empty_"), q("strict $.none", on_error="EMPTY OBJECT").alias("strict_"),
        json_path.json_query(F.col("cut"), "$.a", on_error="EMPTY ARRAY", found=bad["$.a"]).alias("bad"),
    )


@query("""
SELECT event_id, event_type || chr(13) || chr(10) || CAST(event_id AS VARCHAR) AS parts, 'a' || chr(13) || chr(10) || 'b' AS quotes, CAST(NULL AS VARCHAR) AS none FROM events""")
def json_split(t: Tables):
    """Elements of JSON arrays, single quotes read as well."""
    a = F.concat(F.lit('["'), "event_type", F.lit('",'), F.col("event_id").cast("string"), F.lit("]"))
    return t.events.select("event_id", json_path.json_split(a).alias("parts"), json_path.json_split(F.lit("['a', 'b']")).alias("quotes"), json_path.json_split(F.col("props")).alias("none"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_partkey + l_suppkey AS add_, l_partkey - l_suppkey AS sub_, l_partkey * 3 AS mul_, l_partkey // 7 AS div_, l_partkey % 7 AS mod_, CAST(l_partkey AS DOUBLE) / 4 AS quot, CAST(NULL AS DOUBLE) AS by_zero,
  CAST(NULL AS BIGINT) AS int_by_zero, CAST(NULL AS BIGINT) AS mod_zero, l_linenumber AS pos FROM lineitem""")
def math_arith(t: Tables):
    """Arithmetic; division by zero is null."""
    k, z = F.col("l_partkey"), F.col("l_partkey") * 0
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", (k + F.col("l_suppkey")).alias("add_"), (k - F.col("l_suppkey")).alias("sub_"), (k * 3).alias("mul_"), numbers.int_divide(k, F.lit(7)).alias("div_"), (k % 7).alias("mod_"), (k / 4).alias("quot"),
        (k / z).alias("by_zero"), numbers.int_divide(k, z).alias("int_by_zero"), (k % z).alias("mod_zero"), F.positive("l_linenumber").alias("pos"),
    )


@query("""
SELECT p_partkey, p_partkey + 9 AS ok, CAST(NULL AS BIGINT) AS add_, CAST(NULL AS BIGINT) AS sub_, CAST(NULL AS BIGINT) AS mul_, p_partkey / 2 AS div_, CAST(NULL AS DOUBLE) AS div_zero,
  CAST(-9223372036854775808 AS BIGINT) + p_partkey AS wraps FROM part""")
def math_try(t: Tables):
    """try_ forms give null on overflow; plain ones wrap."""
    k, top = F.col("p_partkey"), F.lit(2**63 - 1)
    return t.part.select(
        "p_partkey", F.try_add(k, F.lit(9)).alias("ok"), F.try_add(top, k + 1).alias("add_"), F.try_subtract(-top, k + 2).alias("sub_"), F.try_multiply(top, k + 2).alias("mul_"), F.try_divide(k, F.lit(2)).alias("div_"),
        F.try_divide(k, F.lit(0)).alias("div_zero"), (top + (k + 1)).alias("wraps"),
    )


@query("""
SELECT p_partkey, abs(p_size - 25) AS abs_, round(p_retailprice / 8, 1) AS r1, CAST(round(p_partkey, -2) AS BIGINT) AS r2, pow(p_size, 2) AS p2, (p_partkey - 50) - 7 * floor((p_partkey - 50) / 7) AS pmod_, CAST(floor(p_retailprice) AS BIGINT) AS floor_ FROM part""")
def math_round_pow(t: Tables):
    """Absolute value, rounding half up, powers and the positive remainder."""
    k = F.col("p_partkey")
    return t.part.select(
        "p_partkey", F.abs(F.col("p_size") - 25).alias("abs_"), F.round(F.col("p_retailprice") / 8, 1).alias("r1"), F.round(k, -2).alias("r2"), F.pow("p_size", F.lit(2)).alias("p2"), F.pmod(k - 50, F.lit(7)).cast("double").alias("pmod_"),
        F.floor("p_retailprice").alias("floor_"),
    )


@query("""
SELECT p_partkey, greatest(p_size, 25) AS most, least(p_size, nullif(p_size % 5, 0)) AS least_, greatest(p_retailprice, 1000.0) AS most_d, p_size & 6 AS band, p_partkey >> 2 AS shr, CAST(-8 AS INT) >> 1 AS neg FROM part""")
def math_extreme_bitwise(t: Tables):
    """Extremes that skip nulls, and bits."""
    s = F.col("p_size")
    return t.part.select(
        "p_partkey", F.greatest(s, F.lit(25)).alias("most"), F.least(s, F.nullif(s % 5, F.lit(0))).alias("least_"), F.greatest("p_retailprice", F.lit(1000.0)).alias("most_d"), s.bitwiseAND(6).alias("band"), F.shiftright("p_partkey", 2).alias("shr"),
        F.shiftright(F.lit(-8), 1).alias("neg"),
    )


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(12,2)) AS a, CAST(l_tax AS DECIMAL(4,2)) AS b, CAST(l_quantity AS DECIMAL(10,0)) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(a + b AS DOUBLE) AS add_, CAST(a - b AS DOUBLE) AS sub_, CAST(a * b AS DOUBLE) AS mul_, (CAST(a * 100 AS BIGINT) * 100) // CAST(q AS BIGINT) AS div_, CAST(a % 7 AS DOUBLE) AS mod_, CAST(round(a, 1) AS DOUBLE) AS r1, a > q AS gt,
  CAST(abs(b - a) AS DOUBLE) AS abs_, CAST(a * 100 AS BIGINT) AS digits, CAST(greatest(a, q) AS DOUBLE) AS most FROM d""")
def dec_arith(t: Tables):
    """Decimal arithmetic, comparison, rounding and digits."""
    a, b, q = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_tax").cast("decimal(4,2)"), F.col("l_quantity").cast("decimal(10,0)")
    d = lambda c, n: c.cast("double").alias(n)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", d(a + b, "add_"), d(a - b, "sub_"), d(a * b, "mul_"), F.floor((a / q) * 10000).cast("long").alias("div_"), d(a % 7, "mod_"), d(F.round(a, 1), "r1"), (a > q).alias("gt"), d(F.abs(b - a), "abs_"),
        numbers.unscaled(a, 2).alias("digits"), d(F.greatest(a, q), "most"),
    )


@query("""
SELECT p_partkey, CAST(p_retailprice + 1 AS DOUBLE) AS ok, CAST(NULL AS DOUBLE) AS mul_, CAST(NULL AS DOUBLE) AS by_zero, CAST(p_partkey AS DOUBLE) / 100 AS made, CASE WHEN p_partkey < 1000 THEN CAST(p_partkey AS DOUBLE) / 100 END AS narrow FROM part""")
def dec_try(t: Tables):
    """Decimal results that overflow or divide by zero are null; decimals made of digits."""
    p, big = F.col("p_retailprice").cast("decimal(12,2)"), F.lit("9" * 37).cast("decimal(38,0)")
    k = F.col("p_partkey")
    return t.part.select(
        "p_partkey", F.try_add(p, F.lit(1).cast("decimal(12,2)")).cast("double").alias("ok"), F.try_multiply(big, p).cast("double").alias("mul_"), F.try_divide(p, F.lit(0).cast("decimal(12,2)")).cast("double").alias("by_zero"),
        numbers.make_decimal(k, 12, 2).cast("double").alias("made"), numbers.make_decimal(k, 3, 2).cast("double").alias("narrow"),
    )


@query("""
SELECT o_orderkey, CAST(o_custkey AS SMALLINT) AS short_, CAST(o_custkey AS INT) AS int_, CAST(trunc(o_totalprice) AS BIGINT) AS long_, CAST(o_custkey AS DOUBLE) AS double_, CAST(o_custkey AS VARCHAR) AS str, CAST(split_part(o_orderpriority, '-', 1) AS INT) AS from_str,
  try_cast(o_orderpriority AS INT) AS bad_int, CAST(o_orderdate AS DATE) AS date_, strftime(o_orderdate, '%Y-%m-%d') AS date_str, o_custkey > 0 AS bool_, try_cast(o_orderstatus AS DOUBLE) AS bad_double FROM orders""")
def cast_matrix(t: Tables):
    """Casts between the types; text that is no number is null."""
    c, p = F.col("o_custkey"), F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey", c.cast("short").alias("short_"), c.cast("int").alias("int_"), F.col("o_totalprice").cast("long").alias("long_"), c.cast("double").alias("double_"), c.cast("string").alias("str"), F.substring_index(p, "-", 1).cast("int").alias("from_str"),
        p.cast("int").alias("bad_int"), F.col("o_orderdate").cast("date").alias("date_"), F.col("o_orderdate").cast("date").cast("string").alias("date_str"), c.cast("boolean").alias("bool_"), F.col("o_orderstatus").try_cast("double").alias("bad_double"),
    )


@query("""
SELECT p_partkey, CAST(trunc(p_retailprice) AS INT) AS down, CAST(round(p_retailprice, 0) AS INT) AS half_up, DATE '1996-02-01' AS short_date, CAST(NULL AS DATE) AS full_date, CAST(12.35 AS DOUBLE) AS rounds, CAST(NULL AS DOUBLE) AS strict_,
  CASE WHEN p_size < 10 THEN CAST(p_size AS DOUBLE) END AS fits FROM part""")
def cast_policies(t: Tables):
    """Casts with the policy variants."""
    x = F.col("p_retailprice")
    return t.part.select(
        "p_partkey", numbers.to_integer(x).alias("down"), numbers.to_integer(x, policy=PRESTO_STYLE).alias("half_up"), dates.to_date(F.lit("1996-02")).alias("short_date"), dates.to_date(F.lit("1996-02"), PRESTO_STYLE).alias("full_date"),
        numbers.to_decimal(F.lit("12.345"), 6, 2).cast("double").alias("rounds"), numbers.to_decimal(F.lit("12.345"), 6, 2, Policy(decimal_text_rounds=False)).cast("double").alias("strict_"),
        F.col("p_size").cast("decimal(3,2)").cast("double").alias("fits"),
    )


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CAST(date_trunc('week', d) AS DATE) AS week_, CAST(date_trunc('month', d) AS DATE) AS month_, CAST(date_trunc('quarter', d) AS DATE) AS quarter_, CAST(date_trunc('year', d) AS DATE) AS year_, CAST(NULL AS DATE) AS other,
  CAST(d + INTERVAL 40 DAY AS DATE) AS later, CAST(date_diff('day', DATE '1996-01-01', d) AS INT) AS days FROM o""")
def date_trunc_add_diff(t: Tables):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", dates.trunc_date(d, "WEEK").alias("week_"), dates.trunc_date(d, "MM").alias("month_"), dates.trunc_date(d, "QUARTER").alias("quarter_"), dates.trunc_date(d, "YYYY").alias("year_"), dates.trunc_date(d, "HOUR").alias("other"),
        F.date_add(d, 40).alias("later"), F.datediff(d, F.lit("1996-01-01").cast("date")).alias("days"),
    )


@query("""
SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS unix_, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 28800 AS unix_east, CAST(NULL AS BIGINT) AS bad, CAST(epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS BIGINT) AS midnight,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS text_, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS east FROM events""")
def date_unix(t: Tables):
    """Texts and dates to epoch seconds and back, in time zones."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    unix = dates.unix_timestamp(text)
    return t.events.select(
        "event_id", unix.alias("unix_"), dates.unix_timestamp(text, zone="Asia/Shanghai").alias("unix_east"), dates.unix_timestamp(F.lit("no time")).alias("bad"), F.unix_timestamp(F.col("ts").cast("date")).alias("midnight"),
        dates.from_unixtime(unix).alias("text_"), dates.from_unixtime(unix, "yyyy-MM-dd HH:mm", "Asia/Shanghai").alias("east"),
    )


@query("""
SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text_, strftime(ts + INTERVAL 9 HOUR, '%H:%M') AS tokyo, CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000 AS from_sec, epoch_us(ts) // 1000 AS from_ms, CAST(NULL AS BIGINT) AS other,
  CAST(NULL AS BIGINT) AS out_, epoch_us(ts) // 1000 + 864000000 AS later, CAST(NULL AS BIGINT) AS too_late FROM events""")
def date_epoch_ms(t: Tables):
    """Functions over epoch milliseconds, with their range."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t.events.select(
        "event_id", ms.alias("ms"), dates.from_unix_millis(ms).alias("text_"), dates.from_unix_millis(ms, "HH:mm", "Asia/Tokyo").alias("tokyo"), dates.to_timestamp_ltz(sec, 0).alias("from_sec"), dates.to_timestamp_ltz(ms, 3).alias("from_ms"),
        dates.to_timestamp_ltz(ms, 6).alias("other"), dates.to_timestamp_ltz(ms, 0).alias("out_"), dates.add_days_millis(ms, F.lit(10)).alias("later"), dates.add_days_millis(ms, F.lit(4_000_000)).alias("too_late"),
    )


@query("SELECT event_id, CAST(hour(ts) AS INT) AS utc, CAST(hour(ts + INTERVAL 9 HOUR) AS INT) AS tokyo, 23 AS negative FROM events")
def date_hour(t: Tables):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", dates.hour_of_millis(ms).alias("utc"), dates.hour_of_millis(ms, "Asia/Tokyo").alias("tokyo"), dates.hour_of_millis(F.lit(-1).cast("long")).alias("negative"))


@query()
def hash_mm3_xx64(t: Tables):
    """Murmur3 and xxHash64 of each kind of type; known values are in the tests."""
    return t.customer.select(
        "c_custkey", F.hash("c_custkey").alias("mm3_long"), F.hash("c_name").alias("mm3_str"), F.hash(F.col("c_acctbal")).alias("mm3_double"), F.hash(F.lit(None).cast("int")).alias("mm3_null"), F.xxhash64("c_custkey").alias("xx_long"),
        F.xxhash64("c_name", "c_nationkey").alias("xx_two"), F.xxhash64(F.col("c_nationkey").cast("byte")).alias("xx_byte"),
    )


#: xxHash64 of a 64-bit number, seed 42, in 64-bit steps; null keeps the seed
_XX64 = """
WITH n AS (SELECT c_custkey, nullif(c_custkey % 7, 0) AS key, CAST(18446744073709551616 AS UHUGEINT) AS m, CAST(11400714785074694791 AS UHUGEINT) AS p1, CAST(14029467366897019727 AS UHUGEINT) AS p2,
    CAST(1609587929392839161 AS UHUGEINT) AS p3, CAST(9650029242287828579 AS UHUGEINT) AS p4, CAST(2870177450012600261 AS UHUGEINT) AS p5 FROM customer),
a AS (SELECT *, (CAST(coalesce(key, 0) AS UHUGEINT) * p2) % m AS k FROM n),
b AS (SELECT *, ((k * 2147483648) % m + k // 8589934592) * p1 % m AS r FROM a),
c AS (SELECT *, xor((42 + p5 + 8) % m, r) AS h0 FROM b),
d AS (SELECT *, ((((h0 * 134217728) % m + h0 // 137438953472) * p1) % m + p4) % m AS h1 FROM c),
e AS (SELECT *, (xor(h1, h1 // 8589934592) * p2) % m AS h2 FROM d),
f AS (SELECT *, (xor(h2, h2 // 536870912) * p3) % m AS h3 FROM e),
g AS (SELECT c_custkey, key, CAST(xor(h3, h3 // 4294967296) AS HUGEINT) AS h FROM f)
SELECT c_custkey, CASE WHEN key IS NULL THEN 42 WHEN h >= 9223372036854775808 THEN CAST(h - 18446744073709551616 AS BIGINT) ELSE CAST(h AS BIGINT) END AS xx_long FROM g"""


@query(_XX64)
def hash_xx64_long(t: Tables):
    """xxHash64 of numbers and nulls."""
    return t.customer.select("c_custkey", F.xxhash64(F.nullif(F.col("c_custkey") % 7, F.lit(0)).cast("long")).alias("xx_long"))


@query("SELECT c_custkey, c_custkey * 31 + c_nationkey AS two, (c_custkey * 31 + coalesce(nullif(c_nationkey, 3), 0)) * 31 + 1 AS three FROM customer")
def hash_combine(t: Tables):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return t.customer.select("c_custkey", numbers.combine_hash(k, n).alias("two"), numbers.combine_hash(k, F.nullif(n, F.lit(3)), F.lit(1)).alias("three"))


@query("""
SELECT p_partkey, p_size + 1 AS add1, p_partkey AS id_, round(sqrt((p_size - 3.0) * (p_size - 3.0) + (p_retailprice - 900.0) * (p_retailprice - 900.0)), 6) AS dist, CAST(length(p_name) AS INT) AS len, substr(p_name, 1, 1) AS first FROM part""")
def udf_expressions(t: Tables):
    """The example functions of a plug-in, as plain expressions."""
    s, p = F.col("p_size"), F.col("p_retailprice")
    return t.part.select("p_partkey", udfs.add_one(s).alias("add1"), F.col("p_partkey").alias("id_"), F.round(udfs.distance(s, p, F.lit(3.0), F.lit(900.0)), 6).alias("dist"), F.length("p_name").alias("len"), udfs.first_char(F.col("p_name")).alias("first"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 + 1 AS twice FROM lineitem")
def udf_batch(t: Tables):
    """A Python function over whole batches."""
    ship(t.spark)
    twice = udfs.batch_udf(lambda x: x * 2 + 1, "double")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", twice("l_quantity").alias("twice"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title, p_size + 1 AS next FROM part")
def udf_registered(t: Tables):
    """Functions registered by name and called from SQL."""
    ship(t.spark)

    def title(s: pd.Series) -> pd.Series:
        return s.str[:1].str.upper() + s.str[1:]

    udfs.register(t.spark, {"Tessera_Title": (title, "string"), "Tessera_Next": (lambda x: x + 1, "int")})
    return t.part.selectExpr("p_partkey", "tessera_title(p_name) AS title", "tessera_next(p_size) AS next")


@query("""
SELECT true AS now_, true AS date_, true AS zone, true AS user_, true AS database_, true AS catalog_""")
def session_values(t: Tables):
    """Values of the session: the same for all rows of a query."""
    now = dates.now_millis()
    return t.spark.range(1).select(
        ((now > 1_500_000_000_000) & (now == dates.now_millis())).alias("now_"), F.current_date().isNotNull().alias("date_"), (F.current_timezone() == "UTC").alias("zone"), F.current_user().isNotNull().alias("user_"),
        F.current_database().isNotNull().alias("database_"), F.current_catalog().isNotNull().alias("catalog_"),
    )


@query("SELECT p_partkey, p_size * 2 + 1 AS odd, upper(p_name) AS up FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name LIKE '%ring'")
def expr_text(t: Tables):
    """Expressions given as text, filter and projection fused."""
    return expressions.evaluate(t.part, {"p_partkey": "p_partkey", "odd": "p_size * 2 + 1", "up": "upper(p_name)"}, "p_size BETWEEN 10 AND 20 AND p_name LIKE '%ring'")
