"""Literal cases: IEEE rules, empty input, NaN, and the classifier's grammar."""

import math

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessel.functions import arrays, calendar, classify, distance, elementwise, text
from tessel.plans import catalogue

NAN, INF = float("nan"), float("inf")


def value(spark, column, **columns):
    frame = spark.range(1).select(*[c.alias(n) for n, c in columns.items()], F.lit(0).alias("z_"))
    return frame.select(column.alias("v")).first()["v"]


def doubles(*xs):
    return F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>")


@pytest.mark.parametrize(
    "f,a,b,want",
    [
        (distance.l1, (1, 2, 3, 4), (2, 3, 4, 5), 4), (distance.l2, (3, 4), (0, 0), 5), (distance.dot, (1, 0), (0, 1), 1), (distance.dot, (1, 2, 3), (1, 2, 3), 0),
        (distance.cosine, (0, 0), (1, 1), 1), (distance.cosine, (1, 2), (2, 4), 0), (distance.hamming, (1, 2, 3, 4), (1, 0, 3, 0), 0.5), (distance.jaccard, (1, 1, 0, 1), (1, 0, 1, 1), 0.5),
        (distance.jaccard, (), (), 0), (distance.jaccard, (0, 0), (0, 0), 0), (distance.hellinger, (0.5, 0.5), (0.5, 0.5), 0), (distance.jeffreys, (0.5, 0.5), (0.25, 0.75), 0.25 * math.log(2) - 0.25 * math.log(2 / 3)),
        (distance.jensen_shannon, (1, 0), (0, 1), math.sqrt(math.log(2))),
    ],
)
def test_distance(spark, f, a, b, want):
    assert value(spark, f(doubles(*a), doubles(*b))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("f", [distance.l1, distance.cosine, distance.hamming])
def test_distance_refuses(spark, f):
    for a, b in (((1, 2), (1,)), ((), ())):
        with pytest.raises(PySparkException):
            value(spark, f(doubles(*a), doubles(*b)))
    assert value(spark, f(F.lit(None).cast("array<double>"), doubles(1))) is None


def test_levenshtein_of_any_length(spark):
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")
    assert value(spark, distance.levenshtein(ints([1, 2, 3]), ints([1, 4, 3]))) == 1
    assert value(spark, distance.levenshtein(ints([]), ints([1, 2]))) == 2
    assert value(spark, distance.levenshtein(ints([0xD800, 0xDFFF, 65535]), ints([0xD800, 1, 65535]))) == 1
    assert value(spark, distance.levenshtein(ints(list(range(200))), ints(list(range(3, 200))))) == 3


@pytest.mark.parametrize(
    "f,a,b,want",
    [
        (elementwise.divide, 1, 0, INF), (elementwise.divide, -1, 0, -INF), (elementwise.divide, 1, -0.0, -INF), (elementwise.divide, 0, 0, NAN), (elementwise.divide, NAN, 0, NAN), (elementwise.divide, 7, 2, 3.5),
        (elementwise.modulo, -5.5, 2, -1.5), (elementwise.modulo, 5.5, 0, NAN), (elementwise.equal, NAN, NAN, 0), (elementwise.not_equal, NAN, NAN, 1), (elementwise.greater_than, NAN, 1, 0),
        (elementwise.less_than, 1, NAN, 0), (elementwise.greater_equal, NAN, NAN, 0), (elementwise.less_equal, 2, 2, 1), (elementwise.power, 2, 10, 1024),
    ],
)
def test_two_doubles(spark, f, a, b, want):
    got = value(spark, f(F.col("a"), F.col("b")), a=F.lit(float(a)), b=F.lit(float(b)))
    assert math.isnan(got) if math.isnan(want) else got == want
    assert value(spark, f(F.col("a"), F.col("b")), a=F.lit(None).cast("double"), b=F.lit(float(b))) is None


@pytest.mark.parametrize("name,x,want", [("log", 0, -INF), ("log", -1, NAN), ("log2", 8, 3), ("log10", 0, -INF), ("sqrt", -1, NAN), ("acos", 2, NAN), ("acosh", 0.5, NAN), ("atanh", 2, NAN), ("floor", -1.5, -2), ("ceil", -1.5, -1), ("round", 2.5, 3), ("round", -2.5, -3), ("floor", INF, INF), ("round", 1e300, 1e300), ("sgn", -0.0, 0), ("sgn", NAN, NAN), ("deg", math.pi, 180), ("rad", 180, math.pi)])
def test_one_double(spark, name, x, want):
    got = value(spark, (elementwise.SAME | elementwise.OWN)[name](F.col("x")), x=F.lit(float(x)))
    assert math.isnan(got) if math.isnan(want) else got == pytest.approx(want)


def test_clamps_and_quantise(spark):
    x = F.col("x")
    assert math.isnan(value(spark, elementwise.clamp(x, 0.0, 1.0), x=F.lit(NAN)))
    assert [value(spark, elementwise.quantize(x, 0.0, 20.0, 100.0), x=F.lit(float(v))) for v in (-5, 0, 5, 10, 20, 25, NAN)] == [0, 0, 25, 50, 100, 100, 0]
    assert value(spark, elementwise.to_u32(F.lit(1 << 40))) == elementwise.UINT32
    assert value(spark, elementwise.subtract_saturating(F.lit(3), 5)) == 0


def test_calendar(spark):
    leap = F.lit(1709164800)  # 29 February 2024, a Thursday
    got = {n: value(spark, f(leap)) for n, f in calendar.PARTS.items()}
    assert got == {"timestamp": 1709164800.0, "hour": 0, "minute": 0, "day_of_week": 4, "day_of_month": 29, "day_of_year": 60, "days_in_month": 29, "month": 2, "year": 2024}
    assert value(spark, calendar.day_of_month_approx(F.lit(86400 * 31))) == 2
    assert value(spark, calendar.year_approx(F.lit(86400 * 365))) == 1971


def longs(xs):
    return F.array(*[F.lit(x).cast("bigint") for x in xs]) if xs else F.array().cast("array<bigint>")


def test_arrays(spark):
    a, b = longs([10, 20, 20, 30, 40, 40, 50, 60, 60, 70]), longs([20, 20, 40, 40, 60, 60, 80])
    assert value(spark, arrays.intersect(a, b, dedup=False)) == [20, 20, 40, 40, 60, 60]
    assert value(spark, arrays.intersect(a, b, most=2)) == [20, 40]
    assert value(spark, arrays.difference(longs([1, 1, 2, 2, 3, 3]), longs([2]))) == [1, 1, 3, 3]
    assert value(spark, arrays.difference(longs([1, 1, 2, 2, 3, 3]), longs([]), dedup=True)) == [1, 2, 3]
    assert value(spark, arrays.union([longs([1, 3, 5]), longs([3, 5, 7])], ascending=False)) == [7, 5, 3, 1]
    assert len(value(spark, arrays.dedup(doubles(0.0, -0.0, 1, 1, NAN, NAN)))) == 4
    assert value(spark, arrays.dedup(longs([]))) == []
    assert value(spark, arrays.argsort(doubles(40.5, NAN, 10.2, 20.3))) == [2, 3, 0, 1]
    assert value(spark, arrays.argsort(doubles(40.5, NAN, 10.2, 20.3), ascending=False)) == [0, 3, 2, 1]
    assert value(spark, arrays.is_sorted(longs([1, 1, 2]))) and not value(spark, arrays.is_sorted(longs([2, 1])))
    s = longs([1, 3, 3, 5])
    assert [value(spark, arrays.lower_bound(s, F.lit(t))) for t in (0, 3, 6)] == [0, 1, 4]
    assert [value(spark, arrays.last_at_most(s, F.lit(t))) for t in (0, 3, 6)] == [4, 2, 3]
    assert [value(spark, arrays.after_last_at_most(s, F.lit(t))) for t in (0, 3, 6)] == [0, 3, 4]
    assert value(spark, arrays.in_range(doubles(1, 2, NAN, 3), 2.0, INF)) == [2, 3]


def test_text(spark):
    s = F.col("s")
    tokens = lambda t: value(spark, text.tokenize(s), s=F.lit(t))
    counts = {"don't": 2, "hello.world": 1, "1,000": 2, "version-2.1": 2, "price € 100": 3, "test word": 2, "": 0}
    assert {t: len(tokens(t)) for t in counts} == counts
    assert tokens("a~b~c") == ["a~b", "c"]
    names = ["file.txt", "document.pdf", "image.txt", "script.py", "a_b%c"]
    fits = lambda g, **k: [n for n in names if value(spark, text.matches_wildcard(s, g, **k), s=F.lit(n))]
    assert fits("*.txt") == ["file.txt", "image.txt"] and fits("") == [] and fits("a?b%c") == ["a_b%c"] and fits("FILE.*", case_insensitive=True) == ["file.txt"] and fits("a_b_c") == []
    assert not value(spark, text.has_phrase(s, ""), s=F.lit("x")) and value(spark, text.has_phrase(s, "B C", True), s=F.lit("a b c"))
    fields = F.expr("array(named_struct('name', 'k', 'value', 'Hello there'), named_struct('name', 'j', 'value', 'other'))")
    assert value(spark, text.field_has_phrase(fields, "k", "lo th")) and not value(spark, text.field_has_phrase(fields, "j", "lo th")) and value(spark, text.field_has_phrase(fields, None, "oth"))
    assert value(spark, text.field_starts_with(fields, "k", "hell", True)) and not value(spark, text.field_starts_with(fields, "j", "Hell"))
    assert value(spark, text.fields_text(fields)) == "Hello there other"


CASES = [
    ("192.168.1.1", "IPAddressV4", 3232235777), ("192.168.01.1", "String", 0), ("40.7128,-74.0060", "Geo", 40.7128), ("90.0,180.0", "String", 0), ("Mon Jan 15 14:30:25 2024", "LogDate", 1705329025000),
    ("2024-01-15", "FullDate", 1705276800000), ("2024-Jan-15", "FullDate", 1705276800000), ("2024-02-30", "String", 0), ("1st January 2024", "FinancialDate", 1704067200000), ("11st January 2024", "String", 0),
    ("01/15/2024", "AmericanDate", 1705276800000), ("15/01/2024", "EuropeanDate", 1705276800000), ("02/31/2024", "AmericanDate", 1709337600000), ("01/15/2024 25:00", "AmericanDate", 1705276800000),
    ("[1, 2, 3]", "IntegerArray", 0), ('[1, "mixed", 3.14]', "Array", 0), ("[1, 2, not_a_number]", "String", 0), ("[]", "Array", 0), ("[[1,2],[3]]", "IntegerArray", 0), ('["a","b,c"]', "StringArray", 0),
    ("2001:db8::1", "IPAddressV6", 0), ("::", "IPAddressV6", 0), ("1:2:3:4:5:6:7:8", "IPAddressV6", 0), ("::ffff:1.2.3.4", "IPAddressV6", 0), ("12345::1", "String", 0), ("1:2", "String", 0),
    ("3.14", "Float", 3.14), ("-1e5", "Float", -100000), ("1.", "Float", 1), ("1.e5", "String", 0), ("42", "Integer", 42), ("-7", "Integer", -7), ("123456789012345678901", "Integer", 0),
    ("now", "DateMath", 1e12), ("now+1d", "DateMath", 1e12 + 86400000), ("now-1h/d", "DateMath", 999993600000), ("nowx", "String", 0), ("2024-01-15T14:30:25.5+01:00", "ISO8601Date", 1705325425500),
    ("Mon, 15 Jan 2024 14:30:25 +0000", "RFC2822Date", 1705329025000), ("Monday, the 15th of January, 2024", "VerboseDate", 1705276800000), ("2024/01/15 14:30:25", "GenericDate", 1705329025000),
    ("true", "Boolean", 1), ("True", "String", 0), ("/usr/lib/x.so", "File", 0), ("/", "String", 0), ("null", "Null", 0), ("", "String", 0), ("hello", "String", 0),
]


def test_classify(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(len(CASES), None)], "i int, s string")
    got = {r.i: r.c for r in frame.select("i", classify.classify(F.col("s"), F.lit(10**12)).alias("c")).collect()}
    for i, (s, kind, v) in enumerate(CASES):
        assert (s, got[i].kind, got[i].numeric_value_1) == (s, kind, pytest.approx(v))
    assert got[len(CASES)] is None
    assert [got[i].element_count for i, c in enumerate(CASES) if c[0] in ("[1, 2, 3]", "[1, 2, not_a_number]", "[]", "[[1,2],[3]]")] == [3, 2, 0, 3]
    assert [got[i].numeric_value_2 for i, c in enumerate(CASES) if c[1] == "Geo"] == [pytest.approx(-74.006)]


def test_classify_takes_strings_together():
    strings = ["", None, "1", "[1, 2]", "é", "[]", '["a,b", x]', "2024-02-30", "12/31/2024", "now-1d/d", "[,[true],null]", "10.0.0.1", None, "+.5,-7.", "a" * 50, "[2024-01-15, 2023-Feb-Mon]", "now+" + "9" * 400 + "h/d"]
    clocks = pa.array([1e12] * len(strings))
    whole = classify.of_batch(pa.array(strings, pa.string()), clocks).to_pylist()
    assert whole == [classify.of_batch(pa.array([s], pa.string()), clocks[:1]).to_pylist()[0] for s in strings]
    kinds = ["String", None, "Integer", "IntegerArray", "String", "Array", "String", "String", "AmericanDate", "DateMath", "Array", "IPAddressV4", None, "Geo", "String", "FullDateArray", "DateMath"]
    assert [r and r["kind"] for r in whole] == kinds and whole[-1]["numeric_value_1"] == INF and whole[6]["element_count"] == 1
    sliced = classify.of_batch(pa.array(strings, pa.string())[2:], clocks[2:]).to_pylist()
    assert sliced == whole[2:]


def test_classified_events_are_spread_over_tasks(spark, small_dir, monkeypatch):
    monkeypatch.setattr(catalogue, "EVENTS_A_TASK", 100, raising=False)
    got = catalogue.QUERIES["classify_string"](spark, small_dir).groupBy(F.spark_partition_id()).count().collect()
    assert len(got) >= 10 and sum(r["count"] for r in got) == 1000 * len(catalogue.FORMS)
