"""Fault transforms, checks and fixes on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwell.functions import checks, faults, fixes
from mendwell.functions.faults import faulty
from mendwell.functions.text import canonical_value, key_match, key_token, plain_number, row_text, storage_class


def one(spark, column, value=None, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column.alias("r")).first()["r"]


def fault(spark, name, value, params, index=0, kind="string"):
    dtype = spark.createDataFrame([], f"v {kind}").schema["v"].dataType
    return one(spark, faulty(name, F.col("v"), dtype, F.lit(index), params), value, kind)


@pytest.mark.parametrize("name, value, index, params, expected", [
    ("null", "a", 0, {}, None),
    ("placeholder", "a", 0, {}, "N/A"),
    ("placeholder", "a", 4, {}, "unknown"),
    ("placeholder", "a", 1, {"values": ["?", "none"]}, "none"),
    ("pad_whitespace", "a b", 0, {}, "  a  b   "),
    ("case_noise", "São", 0, {}, "são"),
    ("case_noise", "São", 1, {}, "SÃO"),
    ("date_format", "2016-07-04 08:09:10", 0, {}, "04/07/2016 08:09"),
    ("date_format", "2016-07-04 08:09:10", 1, {}, "07-04-2016 08:09:10"),
    ("date_format", "2016-07-04", 2, {}, "2016/07/04 00:00"),
    ("prefixed_numeric", "30.5", 0, {}, "USD 30.5"),
    ("percent_string", "0.15", 0, {}, "15%"),
    ("percent_string", "0.07", 0, {}, "7%"),
    ("percent_string", "1", 0, {}, "100%"),
    ("country_alias", "USA", 0, {}, "U.S.A."),
    ("country_alias", "Sweden", 0, {}, "sweden"),
    ("date_shift", "2016-07-04", 0, {}, "2017-07-04 00:00:00"),
    ("zero_width", "abcd", 0, {}, "ab\u200bcd"),
    ("zero_width", "a", 0, {}, "a\u200b"),
    ("typo", "abcd", 0, {}, "acbd"),
    ("typo", "abc", 0, {}, "bac"),
    ("typo", "a", 0, {}, "a?"),
    ("typo", "abbc", 0, {}, "abbc?"),
    ("invalid_fk", "ABCDE", 0, {"value": "XXXXX"}, "XXXXX"),
])
def test_text_faults(spark, name, value, index, params, expected):
    assert fault(spark, name, value, params, index) == expected


@pytest.mark.parametrize("name, value, kind, params, expected", [
    ("multiply", 3, "int", {}, 300),
    ("multiply", 0.25, "double", {"factor": 100}, 25.0),
    ("add", 7, "bigint", {}, 100_007),
    ("scale", 30.0, "double", {}, 0.3),
    ("negative", 5, "int", {}, -5),
    ("negative", 0, "int", {}, -1),
    ("negative", -2.5, "double", {}, -2.5),
])
def test_number_faults(spark, name, value, kind, params, expected):
    assert fault(spark, name, value, params, kind=kind) == expected


def test_date_before_counts_from_its_source(spark):
    df = spark.sql("SELECT timestamp_ntz'2016-07-04 10:00:00' AS o, timestamp_ntz'2016-08-01 00:00:00' AS v")
    moved = faulty("date_before", F.col("v"), T.TimestampNTZType(), F.lit(0), {"source_column": "o", "days": 30})
    assert df.select(moved).first()[0] == dt.datetime(2016, 6, 4, 10)


@pytest.mark.parametrize("check, bad, good", [
    (checks.text_in_number, ["USD 3", "", "1,5"], ["3", "3.5", "-1e3", None]),
    (checks.percent_text, ["15%", " 5% "], ["0.15", "%a", None]),
    (checks.not_iso_date, ["04/07/2016 08:09", "07-04-2016"], ["2016-07-04", "2016-07-04 08:09:10", None]),
    (checks.missing_word, ["N/A", " unknown ", "-", "", "NA"], ["none", "0", None]),
    (checks.whitespace_noise, [" a", "a  b", "a\tb"], ["a b", "a", None]),
    (checks.single_case, ["BERN", "bern"], ["Bern", None]),
    (checks.hidden_unicode, ["a\u200bb", "\ufeffa"], ["ab", "é", None]),
    (checks.outside_fraction, ["5", "-0.1"], ["0", "1", "0.5", None]),
])
def test_checks(spark, check, bad, good):
    df = spark.createDataFrame([(v, True) for v in bad] + [(v, False) for v in good], "v string, want boolean")
    wrong = df.filter(~F.coalesce(check(F.col("v")), F.lit(False)).eqNullSafe(F.col("want"))).collect()
    assert wrong == []


@pytest.mark.parametrize("fix, value, expected", [
    (fixes.parse_currency, "USD 30.50", 30.5),
    (fixes.parse_currency, "$-1,5", -1.5),
    (fixes.parse_currency, "none", None),
    (fixes.parse_percent, " 15% ", 0.15),
    (fixes.undo_factor, "2300", 23.0),
    (fixes.undo_factor, "2350", None),
    (fixes.percentage_to_fraction, "7.000000000000001", 0.07),
    (fixes.percentage_to_fraction, "700", None),
    (fixes.absolute, "-3", 3.0),
    (fixes.undo_scale, "0.3266", 32.66),
    (fixes.collapse_whitespace, " \ta  b  c ", "a b c"),
    (fixes.canonical_alias, "México", "Mexico"),
    (fixes.canonical_alias, "Narnia", None),
    (fixes.remove_hidden, "ﬁ\u200bn\ufeff", "fin"),
    (fixes.remove_hidden, "plain", "plain"),
    (fixes.remove_hidden, None, None),
])
def test_fixes(spark, fix, value, expected):
    assert one(spark, fix(F.col("v")), value) == expected


@pytest.mark.parametrize("raw, label, expected", [
    ("04/07/2016 08:09", "2016-07-04 08:09:33", "2016-07-04 08:09:33"),
    ("2016/07/04 00:00", "2016-07-04", "2016-07-04"),
    ("04/07/2016 08:09", "2016-07-05 08:09:33", None),
    ("07-04-2016 08:09:10", "2016-07-04 08:09:10", "2016-07-04 08:09:10"),
    ("07-04-2016 00:00:00", "2016-07-04", "2016-07-04"),
    ("soon", "2016-07-04", None),
])
def test_dates_take_lost_seconds_from_an_agreeing_label(spark, raw, label, expected):
    df = spark.createDataFrame([(raw, label)], "v string, l string")
    assert df.select(fixes.normalize_date(F.col("v"), F.col("l"))).first()[0] == expected


def test_dates_without_a_label(spark):
    assert one(spark, fixes.normalize_date(F.col("v")), "04/07/2016 08:09") == "2016-07-04 08:09:00"
    assert one(spark, fixes.normalize_date(F.col("v")), "31/02/2016 08:09") is None


def test_day_shift_keeps_the_precision_of_its_label(spark):
    df = spark.createDataFrame([("2017-07-04 00:00:00", "2016-07-04"), ("2017-07-04 01:02:03", "2016-07-04 01:02:03")], "v string, l string")
    rows = df.select(fixes.undo_day_shift(F.col("v"), 365, F.col("l")).alias("r")).collect()
    assert [row["r"] for row in rows] == ["2016-07-04", "2016-07-04 01:02:03"]


def test_case_is_restored_only_if_nothing_else_differs(spark):
    df = spark.createDataFrame([("MÜNCHEN", "München"), ("BERN", "Basel")], "v string, l string")
    rows = df.select(fixes.canonical_case(F.col("v"), F.col("l")).alias("r")).collect()
    assert [row["r"] for row in rows] == ["München", None]


def test_keys_and_rows_have_one_text(spark):
    df = spark.createDataFrame([(2, "b\"é", None)], "z int, a string, n string")
    assert df.select(key_token(["z", "a"])).first()[0] == '{"a":"b\\"é","z":2}'
    assert df.select(row_text(df)).first()[0] == '["2","b\\"é",null]'
    blob = spark.createDataFrame([(bytearray(b"ab"),)], "v binary")
    text = blob.select(canonical_value(F.col("v"), T.BinaryType())).first()[0]
    assert text == '{"blob_sha256":"fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603","bytes":2}'


def test_key_match_treats_null_as_a_value(spark):
    df = spark.createDataFrame([(None, None), (1, 1), (1, None)], "a int, b int")
    assert [row[0] for row in df.select(key_match([F.col("a")], [F.col("b")])).collect()] == [True, True, False]


def test_numbers_lose_trailing_zeros(spark):
    df = spark.createDataFrame([(7.000000000000001,), (100.0,), (12.5,), (0.0,)], "v double")
    assert [r[0] for r in df.select(plain_number(F.col("v"))).collect()] == ["7", "100", "12.5", "0"]


def test_storage_classes(spark):
    values = [None, "12", "-1", "1.5", "2e3", "USD 1", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(storage_class(F.col("v"))).collect()] == ["null", "integer", "integer", "real", "real", "text", "text"]


def test_numbers_beyond_doubles_keep_their_digits(spark):
    clean = spark.sql("SELECT 9007199254741023 AS a, CAST('123456789012345678901234.0123456789' AS DECIMAL(34, 10)) AS b")
    for name, kind in (("a", T.LongType()), ("b", T.DecimalType(34, 10))):
        dirty = clean.select(F.col(name), faults.faulty("negative", F.col(name), kind, F.lit(0), {}).alias("n"))
        row = dirty.select(name, "n", fixes.absolute(F.col("n")).cast(kind).alias("back")).first()
        assert str(row["n"]) == f"-{row[name]}" and row["back"] == row[name]


@pytest.mark.parametrize("value, text", [
    (0.123456789, "12.3457%"), (1.23e-9, "1.23e-07%"), (12345.678, "1.23457e+06%"), (0.0, "0%"), (-0.5, "-50%"), (999999.96e-2, "1e+06%"),
])
def test_percent_text_has_six_significant_digits(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(faults.percent_string(F.col("v"), F.lit(0), {})).first()[0] == text == f"{value * 100:g}%"


def test_zero_has_one_text(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-0.0, -0.0)], "v double, w float")
    rows = df.select(canonical_value(F.col("v"), T.DoubleType()), canonical_value(F.col("w"), T.FloatType())).distinct().collect()
    assert [tuple(r) for r in rows] == [("0.0", "0.0")]
