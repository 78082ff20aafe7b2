"""Missing-value, text and time rules on small frames with expectations worked out by hand."""

import datetime as dt
import math
from statistics import NormalDist

from pyspark.sql import functions as F

from fieldtrace.functions import codes, geo, nullsafe, special, text, time
from fieldtrace.operators.joins import ceiling_level, drop_members, natural_join


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_null_keys_match_each_other(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "id int, co string")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "co string, v int")
    assert {tuple(r) for r in natural_join(a, b).collect()} == {(1, None, 10)}
    assert {tuple(r) for r in natural_join(a, b, "full").collect()} == {(1, None, 10), (2, "x", None), (None, "y", 20)}
    assert {tuple(r) for r in natural_join(a, b, "right").collect()} == {(1, None, 10), (None, "y", 20)}
    assert [r.id for r in natural_join(a, b, "left_anti").collect()] == [2]


def test_key_list_is_stated(spark):
    a = spark.createDataFrame([(1, 2)], "id int, x int")
    try:
        natural_join(a, a, expect=["id"])
    except ValueError:
        return
    raise AssertionError("a join on other columns than expected must fail")


def test_conditions_on_null(spark):
    d = spark.createDataFrame([(None,), ("a",), ("b",)], "x string")
    assert col(d, nullsafe.if_else(F.col("x") == "a", F.lit(1), F.lit(0))) == [None, 1, 0]
    assert col(d, nullsafe.is_in("x", ["a"])) == [False, True, False]
    assert col(d, nullsafe.is_in("x", ["a", None])) == [True, True, False]
    assert col(drop_members(d, "x", d.where("x = 'a'")), "x") == [None, "b"]
    assert col(d, nullsafe.glue("x", F.lit("z"), sep="-")) == [None, "a-z", "b-z"]
    assert col(d, nullsafe.null_text("x")) == ["NA", "a", "b"]


def test_numbers_in_text(spark):
    d = spark.createDataFrame([("4a",), ("1,5,2",), ("-0",), ("1d",), (" 7 ",), (None,)], "x string")
    assert col(d, text.replace_first("x", ",:;", "."))[1] == "1.5,2"
    assert col(d, nullsafe.to_number("x")) == [None, None, -0.0, None, 7.0, None]
    n = spark.createDataFrame([(45.0,), (1.5,), (None,)], "x double")
    assert col(n, nullsafe.number_text("x")) == ["45", "1.5", None]
    assert col(spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double"), nullsafe.round_half_even("x")) == [0, 2, 2]


def test_strict_aggregates(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, x double")
    out = {r.k: (r.m, r.s) for r in d.groupBy("k").agg(
        nullsafe.strict_mean("x").alias("m"), nullsafe.strict_sum("x").alias("s")).collect()}
    assert out == {"a": (None, None), "b": (2.0, 2.0)}


def test_sexagesimal(spark):
    d = spark.createDataFrame([("-0", "30", "0"), ("1", "30", None), ("91", "0", "0")], "d string, m string, s string")
    assert col(d, text.dms_to_decimal("d", "m", "s")) == [-0.5, None, 91.0]
    assert col(d, text.dms_to_decimal("d", "m", "s", True)) == [-0.5, 1.5, 91.0]
    assert col(d, text.raw_coordinate("d", "m", "s")) == ["-1:0:30:0", None, "1:91:0:0"]
    assert col(d, text.valid_dms("d", "m", "s")) == [True, False, False]


def test_codes(spark):
    d = spark.createDataFrame([("VOLANT",), ("+1?",), ("2A",), (None,), ("x1",)], "a string")
    assert col(d, text.age_code("a")) == ["1A", "ind", "2A", "ind", "ind"]
    c = spark.createDataFrame([(None,), ("suisse",), ("a swi",), ("Grèce",), ("œuf",)], "a string")
    assert col(c, codes.country_name("a")) == ["FRANCE", "SWITZERLAND", "A SWI", "GREECE", "OEUF"]
    assert col(spark.createDataFrame([("UK",), ("XX",)], "a string"), codes.mapped("a", codes.COUNTRY_CODES)) == ["UKRAINE", "XX"]


def test_clock_change(spark):
    rows = [(dt.datetime(2024, 3, 31), dt.datetime(2024, 3, 31, 2, 30)), (dt.datetime(2024, 3, 31), dt.datetime(2024, 3, 31, 3, 30)),
            (dt.datetime(2024, 1, 10), None)]
    d = spark.createDataFrame(rows, "d timestamp_ntz, h timestamp_ntz")
    got = col(d, F.date_format(time.local_instant("d", "h"), "yyyy-MM-dd HH:mm"))
    assert got == [None, "2024-03-31 01:30", "2024-01-10 11:00"]  # session zone is UTC


def test_days_and_months(spark):
    d = spark.createDataFrame([(dt.date(2001, 4, 15),), (dt.date(2001, 4, 16),), (dt.date(2000, 4, 15),), (dt.date(2001, 12, 31),)], "d date")
    assert col(d, time.in_days("d", time.NESTING_DAYS)) == [False, True, True, False]
    assert col(d, time.month_before("d"))[3] is None
    assert col(d, time.shifted_winter("d")) == [2001, 2001, 2000, None]
    assert col(d, time.winter("d")) == [2000, 2000, 1999, 2001]
    assert col(d, time.season("d")) == ["départ_repro", "repro", "repro", "hivernage"]


def test_levels(spark):
    level, place = ceiling_level("n", [1, 2, 5])
    d = spark.createDataFrame([(1,), (3,), (9,)], "n int")
    assert [tuple(r) for r in d.select(level, place).collect()] == [(1, 1), (5, 3), (None, None)]


def test_geography(spark):
    d = spark.createDataFrame([(3.0, 46.5), (-10.0, 35.0), (18.0, 55.0)], "lon double, lat double")
    x, y = geo.to_lambert("lon", "lat")
    got = [(round(r[0], 3), round(r[1], 3)) for r in d.select(x, y).collect()]
    assert got == [(700000.0, 6600000.0), (-502924.178, 5415141.481), (1664384.432, 7640147.180)]
    quarter = spark.range(1).select(geo.distance_km(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0))).first()[0]
    assert abs(quarter - 6371.01 * math.pi / 2) < 1e-9
    beside = spark.range(1).select(geo.segment_distance_km(F.lit(5.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0))).first()[0]
    assert abs(beside - 6371.01 * math.radians(1)) < 1e-6


def test_special_functions(spark):
    ps = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.9, 0.99999]
    d = spark.createDataFrame([(p,) for p in ps], "p double")
    assert all(abs(a - NormalDist().inv_cdf(p)) < 1e-12 * max(1, abs(a)) for a, p in zip(col(d, special.normal_quantile("p")), ps))
    zs = [0.1, 0.5, 1.0, 3.7, 50.0]
    z = spark.createDataFrame([(v,) for v in zs], "z double")
    assert all(abs(a - math.lgamma(v)) < 1e-11 for a, v in zip(col(z, special.log_gamma("z")), zs))
    r = spark.createDataFrame([(v,) for v in (0.01, 0.3, 0.8, 0.99)], "r double")
    back = r.select("r", special.bessel_ratio(special.von_mises_kappa("r")).alias("b")).collect()
    assert all(abs(x.r - x.b) < 1e-9 for x in back)
