"""Summaries, keys, values, kinds, dates, histograms and words on small frames."""

import datetime as dt

import pytest

from tableprofile.operators import filters, histograms, kinds, summary, trends, values, words
from tableprofile.functions.columns import type_labels
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a", None), (2, float("nan"), "NULL", None), (3, None, None, None), (4, -0.0, "a", None), (5, 0.0, "b", None)],
        "id int, x double, s string, none string")


@pytest.fixture(scope="module")
def empty(spark, nulls):
    return spark.createDataFrame([], nulls.schema)


def test_type_labels(spark):
    df = spark.sql("""SELECT 1Y a, 1 b, 1.5D c, 1.5 d, 'x' e, true f, DATE'2024-01-01' g, TIMESTAMP'2024-01-01' h,
                      array(1) i, map('a',1) j, struct(1) k, X'00' l""")
    assert list(type_labels(df).values()) == [
        "int", "int", "float", "float", "string", "bool", "datetime", "datetime", "other", "other", "other", "other"]


def test_field_summary_nulls(nulls):
    got = {r.field: (r.type, r.coverage_pct, r.nulls, r.distinct_values) for r in summary.field_summary(nulls).collect()}
    assert got == {"id": ("int", 100.0, 0, 5), "x": ("float", 60.0, 2, 2), "s": ("string", 80.0, 1, 3),
                   "none": ("string", 0.0, 5, 0)}
    approx = {r.field: (r.nulls, r.distinct_values) for r in summary.field_summary(nulls, approx=True).collect()}
    assert approx == {"id": (0, 5), "x": (2, 2), "s": (1, 3), "none": (5, 0)}
    assert {r.field: r.coverage_pct for r in summary.coverage(nulls).collect()} == {
        "id": 100.0, "x": 60.0, "s": 80.0, "none": 0.0}


def test_field_summary_all_types(spark):
    df = spark.sql("""SELECT * FROM VALUES (true, DATE'2024-01-01', TIMESTAMP'2024-01-01', array(1), struct(1), X'00', 1.5),
                      (false, DATE'2024-01-01', null, array(2), struct(1), X'01', 1.5) t(a, b, c, d, e, f, g)""")
    got = {r.field: r.distinct_values for r in summary.field_summary(df).collect()}
    assert got == {"a": 2, "b": 1, "c": 1, "d": 2, "e": 1, "f": 2, "g": 1}
    assert {r.field: r.distinct_values for r in summary.field_summary(df, approx=True).collect()} == got


def test_long_values_are_told_apart(spark):
    text = "x" * 500
    df = spark.createDataFrame([(text + "a",), (text + "b",), (text + "a",)], "t string")
    assert summary.field_summary(df).first().distinct_values == 2


def test_empty_and_one_row(spark, empty, nulls):
    got = summary.field_summary(empty).collect()
    assert [r.field for r in got] == ["id", "x", "s", "none"] and {r.distinct_values for r in got} == {0}
    assert {r.coverage_pct for r in got} == {0.0}
    assert summary.detect_keys(empty).count() == 0
    assert values.top_values(empty).count() == 0
    assert histograms.histogram(empty, "x").count() == 0
    one = nulls.where("id = 1")
    assert {r.field for r in summary.detect_keys(one).collect()} == {"id", "x", "s"}
    assert histograms.histogram(one, "x").collect()[0]["count"] == 1
    assert summary.dataset_stats(empty).first().total_rows == 0


def test_dotted_column_names(spark):
    df = spark.createDataFrame([(1, "a")], ["a.b", "c`d"])
    assert {r.field for r in summary.field_summary(df).collect()} == {"a.b", "c`d"}
    assert values.top_values(df).where("value <> 'Total'").count() == 2


def test_keys_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3), (None, "c", 4), (1, "a", 5)],
                               "k1 int, k2 string, v int")
    r = summary.check_composite_key(df, ["k1", "k2"]).first()
    assert (r.total_rows, r.unique_keys, r.is_key) == (5, 2, False)
    assert summary.check_composite_key(df, ["v"]).first().is_key
    assert summary.key_in_force(df) == ["v"] and summary.key_in_force(df, ["k1", "k2"]) == ["k1", "k2"]
    # one row per key, null parts equal to each other
    got = {(r.value, r["count"]) for r in values.top_values_per_key(df, ["k1", "k2"], ["v"], "v").collect()}
    assert got == {("1", 1), ("2", 1), ("3", 1), ("Total", 3)}
    assert summary.drop_nulls(df, ["k1"]).count() == 3


def test_top_values_merge_null_text(nulls):
    got = {(r.value, r["count"], r.percentage) for r in values.top_values(nulls, ["s"]).collect()}
    assert got == {("a", 2, 40.0), ("NULL", 2, 40.0), ("b", 1, 20.0), ("Total", 5, 100.0)}


def test_top_values_keeps_ten(spark):
    df = spark.range(1000).selectExpr("cast(least(id, 30) as string) v")
    got = [r.value for r in values.top_values(df, ["v"]).collect()]
    assert len(got) == 11 and "30" in got


def test_float_text(spark):
    df = spark.createDataFrame([(1e10,), (12345678.5,), (0.0005,), (1e20,), (2.0,), (-123456789.125,)], "x double")
    assert {r.value for r in values.unique_values(df, "x").collect()} == {
        "10000000000.0", "12345678.5", "0.0005", "1.0E20", "2.0", "-123456789.125"}


def test_chart_labels(spark):
    df = spark.createDataFrame([("x" * 60,), ("y",), ("y",)], "v string")
    got = {(r.value, r.label) for r in values.chart_rows(df).collect()}
    assert got == {("x" * 47 + "...", "x" * 47 + "... (1, 33.3%)"), ("y", "y (2, 66.7%)")}


def test_filters(spark, rows):
    df = spark.createDataFrame([(1, "Alpha.1", 1.0), (2, "beta", float("nan")), (3, None, 3.0), (4, "none", None)],
                               "id int, s string, x double")
    def ids(spec):
        return [r[0] for r in rows(filters.apply_filters(df, spec), "id")]
    assert ids({"s": {"type": "contains", "value": "A.1"}}) == [1]
    assert ids({"s": {"type": "contains", "value": "n"}}) == [4]
    assert ids({"s": {"type": "starts_with", "value": "AL"}}) == [1]
    assert ids({"s": {"type": "regex", "value": r"a\D+1"}}) == [1]
    assert ids({"s": {"type": "regex", "value": "eta"}}) == []
    assert ids({"s": {"type": "regex", "value": "z|b"}}) == [2]
    assert ids({"x": {"type": "range", "min": 1.0, "max": 3.0}}) == [1, 3]
    assert ids({"x": {"type": "greater_than", "value": 1.0}}) == [3]
    assert ids({"x": {"type": "less_than", "value": 3.0}}) == [1]
    assert ids({"id": {"type": "equals", "values": [1, 3]}, "x": {"type": "greater_than", "value": 1.0}}) == [3]
    assert [r.value for r in filters.filter_choices(df, "s").collect()] == ["Alpha.1", "beta"]
    assert [r.value for r in filters.filter_choices(df, "x").collect()] == [1.0, 3.0]
    assert tuple(filters.filter_bounds(df, ["x"]).first())[1:] == (1.0, 3.0, 2.0)
    with pytest.raises(ValueError):
        filters.apply_filters(df, {"nope": {"type": "equals", "values": []}})


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    out = filters.apply_filters(df, {"p_size": {"type": "range", "min": 1, "max": 5}}).select("p_partkey", "p_size")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,1)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


DATES = {
    "2024-01-05": "2024-01-05", "01/25/2024": "2024-01-25", "25/01/2024": "2024-01-25", "05/01/2024": "2024-05-01",
    "Jan 5, 2024": "2024-01-05", "5-Jan-24": "2024-01-05", "20240105": "2024-01-05", "2024": "2024-01-01",
    "2024/1/5": "2024-01-05", "5 January 2024": "2024-01-05", "2024-01-05 10:30:00": "2024-01-05",
    "2024-01-05T10:30:00": "2024-01-05", "01/25/2024 10:30": "2024-01-25", "12:30": None, "5-LOW": None, "abc": None,
    "99999999": None, "": None, "13/13/2024": None,
}


def test_date_parsing(spark):
    from tableprofile.functions.dates import parse_date
    df = spark.createDataFrame([(k,) for k in DATES], "v string")
    got = {r.v: r.d for r in df.select("v", parse_date(F.col("v")).cast("date").cast("string").alias("d")).collect()}
    assert got == DATES


def test_everyday_date_texts(spark):
    from tableprofile.functions.dates import parse_date
    want = {"1/25/24": "2024-01-25 00:00", "01/25/2024 10:30 AM": "2024-01-25 10:30", "1/25/2024 9:05:06 pm": "2024-01-25 21:05",
            "Jan 5 2024": "2024-01-05 00:00", "2024.01.05": "2024-01-05 00:00", "25-01-2024": "2024-01-25 00:00", "01-25-2024": "2024-01-25 00:00",
            "Fri, 05 Jan 2024": "2024-01-05 00:00", "Friday Jan 5, 2024": "2024-01-05 00:00", "5-Jan-99": "1999-01-05 00:00", " " * 40 + "2024-01-05": "2024-01-05 00:00",
            "January 5, 2024 10:30": "2024-01-05 10:30", "2024-1-5 3:04:05 PM": "2024-01-05 15:04", "05 Jan 2024 10:00": "2024-01-05 10:00",
            "Sept 5, 2024": "2024-09-05 00:00", "5 Sept 2024": "2024-09-05 00:00", "Jan 5, 2024, 3:04 pm": "2024-01-05 15:04",
            "5 January 2024 12:00 AM": "2024-01-05 00:00", "September 5 2024 23:59:59": "2024-09-05 23:59", "2024-13-5 3:04 PM": None, "Mayor 5, 2024": None,
            "1/25/24x": None, "13-13-2024": None, "Fri": None, "12:30 AM": None}
    df = spark.createDataFrame([(v,) for v in want], "v string")
    assert {r.v: r.d for r in df.select("v", F.date_format(parse_date(F.col("v")), "yyyy-MM-dd HH:mm").alias("d")).collect()} == want


def test_distinct_times_without_zone(spark):
    from tableprofile.operators.summary import field_summary
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00.000001' + make_dt_interval(0, 0, 0, id % 7) AS t FROM range(100)")
    assert field_summary(df).first().distinct_values == 7


def test_date_share_threshold(spark):
    def frame(good):
        return spark.createDataFrame([(i, "2024-01-05" if i < good else "x") for i in range(100)], "id int, v string")
    assert not kinds.detect_dates(frame(89), ["v"], "id").first().is_date
    assert kinds.detect_dates(frame(90), ["v"], "id").first().is_date
    digits = spark.createDataFrame([(i, "20240105") for i in range(20)], "id int, v string")
    assert not kinds.detect_dates(digits, ["v"], "id").first().is_date


def test_kinds(spark):
    words_ = "lorem ipsum dolor sit amet " * 4
    df = spark.createDataFrame(
        [(i, f"u{i}", i % 7, "2024-01-05", words_ + str(i % 3), "ab"[i % 2], str(i % 8), i % 2 == 0, "1" * 60) for i in range(20)],
        "id int, u string, n int, d string, t string, c string, b string, flag boolean, nums string")
    got = {r.field: r.kind for r in kinds.field_kinds(df, row_id="id").collect()}
    assert got == {"id": "unique", "u": "unique", "n": "numeric", "d": "datetime", "t": "long_text", "c": "donut",
                   "b": "bar", "flag": "donut", "nums": "donut"}


def test_trend_fills_gaps(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 3, 5),), (dt.datetime(2024, 1, 20),), (dt.datetime(2024, 3, 1),), (None,)],
                               "ts timestamp")
    sizes = {p: trends.trend(df, "ts", p).collect() for p in ("day", "week", "month", "quarter", "year")}
    assert {p: len(r) for p, r in sizes.items()} == {"day": 59, "week": 9, "month": 3, "quarter": 1, "year": 1}
    assert all(sum(r["count"] for r in rs) == 3 for rs in sizes.values())
    assert [str(r.period) for r in sizes["month"]] == ["2024-01-31", "2024-02-29", "2024-03-31"]
    assert [r["count"] for r in sizes["month"]] == [2, 0, 1]
    assert str(sizes["week"][0].period) == "2024-01-07" and str(sizes["quarter"][0].period) == "2024-03-31"
    text = df.select(F.date_format("ts", "MMM d, yyyy").alias("v"))
    assert len(trends.trend(text, "v", "day").collect()) == 59
    assert trends.date_listing(df, "ts").count() == 3


def test_histogram_steps():
    assert histograms.nice_step(0, 30, 30) == 2.0
    assert histograms.nice_step(0, 29, 30) == 1.0
    assert histograms.nice_step(900, 105000, 30) == 5000.0
    assert histograms.nice_step(-0.01, 0.01, 30) == 0.001
    assert histograms.nice_step(5, 5, 30) == 1.0


def test_histogram_without_infinity(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    assert sum(r["count"] for r in histograms.histogram(df, "x").collect()) == 2
    assert sum(r["count"] for r in histograms.outlier_histogram(df, "x").collect()) == 2


def test_word_pairs(spark):
    """A pair that always stands together becomes an entry; its words keep what is left of their counts."""
    rows = [("New York is far",)] * 40 + [(f"old town number{i} far",) for i in range(40)] + [("york 12 new",), ("new the york",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = {r.word: r["count"] for r in words.word_counts(df, "t", ["the", "is"], pairs=True).collect()}
    assert got["new york"] == 40 and got["old town"] == 40 and "old" not in got and got["new"] == got["york"] == 2
    assert got["far"] == 80 and "york far" not in got
    plain = {r.word: r["count"] for r in words.word_counts(df, "t", ["the", "is"]).collect()}
    assert plain["new"] == 42 and "new york" not in plain
    assert words.word_counts(df.where("false"), "t", pairs=True).count() == 0


def test_word_counts(spark):
    df = spark.createDataFrame([("The cars' car; John's glass 42 été bus buses x",), ("Cars glass ÉTÉ",)], "t string")
    got = {r.word: r["count"] for r in words.word_counts(df, "t", ["the"]).collect()}
    # trailing apostrophes belong to the word; "bus" has no singular in the text
    assert got == {"cars'": 1, "car": 2, "john": 1, "glass": 2, "été": 2, "bus": 1, "buses": 1}


def test_insights(spark):
    from tableprofile.operators.insights import insights
    df = spark.createDataFrame(
        [(i, i % 7, "2024-01-05", "lorem ipsum dolor sit amet " * 3 + str(i % 3), "ab"[i % 2], i // 2) for i in range(20)],
        "id int, n int, d string, t string, c string, k int")
    got = insights(df, row_id="id", keys=["k"])
    assert {f: (o.kind, sorted(o.tables)) for f, o in got.items()} == {
        "id": ("unique", ["unique_values"]), "n": ("numeric", ["histogram", "top_values"]),
        "d": ("datetime", ["dates", "trend_day", "trend_month", "trend_quarter", "trend_week", "trend_year"]),
        "t": ("long_text", ["top_values", "top_values_per_key", "words"]),
        "c": ("donut", ["chart", "top_values", "top_values_per_key"]), "k": ("numeric", ["histogram", "top_values"])}
    assert {(r.value, r["count"]) for r in got["c"].tables["top_values_per_key"].collect()} == {("a", 10), ("Total", 10)}
    assert got["d"].tables["trend_day"].first()["count"] == 20


def test_filter_reaches_the_scan(spark):
    from tableprofile.workload import QUERIES
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = QUERIES["filter_and"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "GreaterThan(l_extendedprice,60000.0)" in plan
    assert "l_comment" not in plan and "l_shipdate" not in plan


def test_word_pairs_read_the_texts_twice(spark):
    """Once for words, once for pairs, however often the counts are used; and plain functions do what the patterns did."""
    from pyspark.sql import functions as F
    from tableprofile.operators import words
    df = spark.createDataFrame([("john's cat ate 12 ٣٤ big 9 fish's 'x _y 1a a1's é's",), ("big fish " * 40,), (None,), ("",)], "t string")
    texts = df.select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit(words.WORD), F.lit(0))).alias("w"))
    old = texts.select(F.regexp_replace("w", "'s$", "").alias("w")).where((F.col("w") != "") & ~F.col("w").rlike(r"^\p{Nd}+$"))
    new = texts.select(words._cleaned(F.col("w")).alias("w")).where(words._is_word(F.col("w")))
    assert sorted(r.w for r in new.collect()) == sorted(r.w for r in old.collect()) and new.where("w = 'john'").count() == 1
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = df.repartition(1).mapInArrow(count, "t string")
    got = {r.word: r["count"] for r in words.word_counts(counted, "t", top=None, pairs=True).collect()}
    # 'fish' and 'fish's' are one word, whose pairs count once
    assert got["big fish"] == 41 and seen.value == 2 * 4
