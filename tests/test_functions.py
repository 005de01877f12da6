import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, expressions, json_path, numbers, strings, udfs
from tessera.functions.policy import PRESTO_STYLE, Policy


@pytest.fixture(scope="module")
def value(spark):
    """The value of a column expression over no input."""
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


L = F.lit


@pytest.mark.parametrize(("json", "path", "want"), [
    ('{"name":"John","age":30}', "$.age", "30"), ("[1,2,3,4,5]", "$[4]", "5"), ('{"key.with.dot":"v"}', "$['key.with.dot']", "v"), ('{"key.with.dot":"v"}', '$["key.with.dot"]', "v"),
    ('{"a":null}', "$.a", None), ('{"a":1}', "$.b", None), ("[1]", "$[7]", None), ('{"a":{"b":1}}', "$.a", None), ('{"a":[1]}', "$.a", None), ('{"a":true}', "$.a", "true"), ('{"a":', "$.a", None), (None, "$.a", None),
])
def test_json_value(value, json, path, want):
    assert value(json_path.json_value(L(json).cast("string"), path)) == want


def test_json_value_behaviours(value):
    f = json_path.json_value_on
    good = L('{"a":{"b":1},"c":null}')
    assert value(f(good, "$.x", "DEFAULT", "NULL", "d")) == "d"
    assert value(f(good, "$.a", "DEFAULT", "NULL", "d")) == "d"
    assert value(f(good, "$.c", "DEFAULT", "NULL", "d")) == "d"
    assert value(f(good, "$", "NULL", "DEFAULT", None, "e")) == "e"
    assert value(f(good, "lax $.a", "NULL", "DEFAULT", None, "e")) == "e"
    assert value(f(good, None, "NULL", "DEFAULT", None, "e")) == "e"
    assert value(f(L(None).cast("string"), "$.a", "NULL", "DEFAULT", None, "e")) == "e"
    with pytest.raises(Exception, match="json_value: empty"):
        value(f(good, "$.x", "ERROR"))


@pytest.mark.parametrize(("json", "path", "args", "want"), [
    ('{"a":{"b":1}}', "$.a", {}, '{"b":1}'), ('{"a":[1,2]}', "lax $.a", {}, "[1,2]"), ('{"a":"A"}', "$.a", {}, None), ('{"a":"A"}', "$.a", {"wrapper": "CONDITIONAL"}, '["A"]'), ('{"a":[1]}', "$.a", {"wrapper": "CONDITIONAL"}, "[1]"),
    ('{"a":[1]}', "$.a", {"wrapper": "UNCONDITIONAL"}, "[[1]]"), ('{"a":{"b":1}}', "$.a", {"wrapper": "CONDITIONAL"}, '[{"b":1}]'), ('{"a":"A"}', "$.a", {"on_empty": "EMPTY ARRAY"}, "[]"),
    ('{"a":"A"}', "strict $.a", {"on_error": "EMPTY OBJECT", "on_empty": "EMPTY ARRAY"}, "{}"), ('{"a":1}', "$.b", {"on_empty": "EMPTY OBJECT"}, "{}"), ('{"a":1}', "strict $.b", {"on_error": "EMPTY ARRAY"}, "[]"),
    ('{"a":null}', "strict $.a", {"on_empty": "EMPTY ARRAY", "on_error": "EMPTY OBJECT"}, "[]"), ("{", "$.a", {"on_error": "EMPTY ARRAY"}, "[]"), ('{"a":1}', "a", {"on_error": "EMPTY ARRAY"}, "[]"), (None, "$.a", {"on_error": "EMPTY ARRAY"}, None),
    ('{"a":1}', None, {"on_error": "EMPTY ARRAY"}, None), ('{"a":"q\\"x"}', "$.a", {"wrapper": "UNCONDITIONAL"}, '["q\\"x"]'),
])
def test_json_query(value, json, path, args, want):
    assert value(json_path.json_query(L(json).cast("string"), path, **args)) == want


def test_json_query_error(value):
    with pytest.raises(Exception, match="json_query: error"):
        value(json_path.json_query(L("{"), "$.a", on_error="ERROR"))


@pytest.mark.parametrize("name", ["json_query", "json_value"])
def test_json_work_is_dealt_by_rows_and_compiled(spark, monkeypatch, name):
    from tessera import runtime
    from tessera.plans import catalogue

    monkeypatch.setattr(runtime, "TASK_ROWS", 100, raising=False)
    df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == -(-sum(tasks) // 100) and max(tasks) < 200
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


def test_json_look_up_gives_the_same(spark):
    texts = [None, "", "{", "null", '{"a":null}', '{"a":{"b":[1,"x",null]}}', '{"a":[1.50]}', '{"a":"[1]"}', '{"a":"q\\"x"}', '{"a":1,"a":2}', '{"b":1} tail', '[{"a":1}]']
    df, at = json_path.look_up(spark.createDataFrame([(t,) for t in texts], "j string"), "j", "$.a", '$["a"]["b"]')
    cases = []
    for path, found in at.items():
        for w in ("WITHOUT", "CONDITIONAL", "UNCONDITIONAL"):
            cases += [[json_path.json_query(F.col("j"), f"{mode} {path}", w, "EMPTY ARRAY", "EMPTY OBJECT", f) for f in (None, found)] for mode in ("lax", "strict")]
        cases += [[json_path.json_value(F.col("j"), path, f) for f in (None, found)], [json_path.json_value_on(F.col("j"), path, "DEFAULT", "DEFAULT", "empty", "error", f) for f in (None, found)]]
    for plain, shared in cases:
        assert [r for r in df.select(plain.alias("p"), shared.alias("s")).collect() if r.p != r.s] == []


def test_json_split(value):
    assert value(json_path.json_split(L('["a",1,{"b":2}]'))) == 'a\r\n1\r\n{"b":2}'
    assert value(json_path.json_split(L('{"a":1}'))) is None
    assert value(json_path.json_split(L("not json"))) is None


def test_strings(spark):
    cases = [
        (strings.substr(L("apple"), -7, 3), "a"), (strings.substr(L("apple"), -7, 3, PRESTO_STYLE), ""), (strings.substr(L("apple"), 0, 2), "ap"), (strings.substr(L("apple"), 0, 2, PRESTO_STYLE), ""), (strings.substr(L("apple"), 2), "pple"),
        (strings.replace(L("apple"), "", "*"), "apple"), (strings.replace(L("apple"), "", "*", PRESTO_STYLE), "*a*p*p*l*e*"), (strings.regexp_extract_null(L("a1"), r"b(\d)"), None), (strings.regexp_extract_null(L("é1"), r"é(\d)"), "1"),
        (strings.regexp_extract_null(L("a1"), r"a(\d)", 2), None), (strings.count_char(L("banana"), "an"), 3), (strings.split_index(L("a.b.c"), ".", 1), "b"), (strings.split_index(L("a.b.c"), ".", 3), None), (strings.split_index(L("abc"), "|", 0), "abc"),
        (strings.empty_to_null(L("")), None), (strings.char_pad(L("ab"), 4), "ab  "), (strings.varchar_write_check(L("ab   "), 3), "ab "), (strings.varchar_write_check(L(None).cast("string"), 3), None), (strings.char_write_check(L("ab"), 3), "ab "),
        (strings.char_write_check(L("ab    "), 3), "ab "), (strings.like_char(L("ab"), 4, "ab  "), True), (strings.concat_char(L("a"), 2, L("b")), "a b"),
        (F.concat_ws("-", L("a"), L(None).cast("string"), L("b")), "a-b"), (F.substring_index(L("a.b.c"), ".", 0), ""), (F.instr(L("abc"), ""), 1),
    ]
    row = spark.range(1).select(*(c.alias(f"c{k}") for k, (c, _) in enumerate(cases))).first()
    assert list(row) == [want for _, want in cases]


@pytest.mark.parametrize("check", [strings.varchar_write_check, strings.char_write_check])
def test_write_checks_refuse_long_values(value, check):
    with pytest.raises(Exception, match="exceeds"):
        value(check(L("abcd"), 3))


def test_numbers(spark):
    cases = [
        (numbers.int_divide(L(-7), L(2)), -3), (numbers.int_divide(L(7), L(0)), None), (L(5) % L(0), None), (L(1) / L(0), None), (F.try_add(L(2**31 - 1), L(1)), None), (L(2**31 - 1) + L(1), -(2**31)), (F.round(L(2.5)), 3.0), (F.round(L(-2.5)), -3.0),
        (numbers.to_integer(L(2.7)), 2), (numbers.to_integer(L(2.5), policy=PRESTO_STYLE), 3), (numbers.to_integer(L(-2.7)), -2), (F.shiftright(L(-8), 1), -4), (F.pmod(L(-7), L(3)), 2), (F.hash(L(1)), -559580957), (F.xxhash64(L(1)), -6698625589789238999),
        (F.hash(L(None).cast("int")), 42), (numbers.combine_hash(L(2), L(3), L(None).cast("int")), (2 * 31 + 3) * 31), (L("abc").cast("int"), None), (numbers.unscaled(L("12.34").cast("decimal(6,2)"), 2), 1234), (F.greatest(L(1), L(None).cast("int")), 1),
    ]
    row = spark.range(1).select(*(c.alias(f"c{k}") for k, (c, _) in enumerate(cases))).first()
    assert list(row) == [want for _, want in cases]


def test_decimals(value):
    from decimal import Decimal

    assert value(numbers.make_decimal(L(1234), 6, 2)) == Decimal("12.34")
    assert value(numbers.make_decimal(L(123456), 4, 2)) is None
    assert value(numbers.to_decimal(L("12.345"), 6, 2)) == Decimal("12.35")
    assert value(numbers.to_decimal(L("12.345"), 6, 2, Policy(decimal_text_rounds=False))) is None
    assert value(numbers.to_decimal(L("99999.1"), 6, 2)) is None


def test_dates(spark):
    cases = [
        (dates.to_timestamp_ltz(L(1), 0), 1000), (dates.to_timestamp_ltz(L(1), 3), 1), (dates.to_timestamp_ltz(L(1), 9), None), (dates.to_timestamp_ltz(L(2**40), 0), None), (dates.add_days_millis(L(0), L(2)), 172_800_000),
        (dates.add_days_millis(L(dates.LAST_MS), L(1)), None), (dates.hour_of_millis(L(-1)), 23), (dates.hour_of_millis(L(0), "Asia/Shanghai"), 8), (dates.from_unixtime(L(0), "yyyy-MM-dd HH", "Asia/Shanghai"), "1970-01-01 08"),
        (dates.from_unix_millis(L(-1)), "1969-12-31 23:59:59"), (dates.unix_timestamp(L("1970-01-02"), "yyyy-MM-dd"), 86400), (dates.unix_timestamp(L("1970-01-01 08:00:00"), zone="Asia/Shanghai"), 0), (dates.unix_timestamp(L("x")), None),
        (dates.trunc_date(L("2024-05-15").cast("date"), "WEEK").cast("string"), "2024-05-13"), (dates.trunc_date(L("2024-05-15").cast("date"), "QUARTER").cast("string"), "2024-04-01"), (dates.trunc_date(L("2024-05-15").cast("date"), "DAY"), None),
        (dates.to_date(L("1996-02")).cast("string"), "1996-02-01"), (dates.to_date(L("1996-02"), PRESTO_STYLE), None),
    ]
    row = spark.range(1).select(*(c.alias(f"c{k}") for k, (c, _) in enumerate(cases))).first()
    assert list(row) == [want for _, want in cases]


def test_overflow_policy(value):
    big = L("9" * 37).cast("decimal(38,0)")
    assert value(numbers.on_overflow(big * big, big)) is None
    assert value(numbers.on_overflow(big * L(None).cast("int"), big, L(None).cast("int"), policy=Policy(overflow_error=True))) is None
    with pytest.raises(Exception, match="decimal overflow"):
        value(numbers.on_overflow(big * big, big, policy=Policy(overflow_error=True)))


def test_registration_file():
    lines = ["# name class", "", "Add1Int32 org.example.Add1", "LENGTHSTR org.example.Length extra", "lonely"]
    assert udfs.read_registration(lines) == {"add1int32": "org.example.Add1", "lengthstr": "org.example.Length"}


def test_expressions_are_checked_without_running(spark):
    assert expressions.unsupported(spark, "a int, s string", "substr(s, a, 2) LIKE 'x%' AND a IN (1, NULL)") is None
    for wrong in ("nothing(a)", "b + 1", "a +", "transform(a, x -> x)"):
        assert expressions.unsupported(spark, "a int, s string", wrong)
