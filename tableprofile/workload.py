"""The registered queries: every operator on the whole of one of the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableprofile.operators import (
    consensus, dbscan, extraction, features, filters, geo, histograms, insights, isolation_forest, keyword_table, kinds, kmeans, lof,
    outliers, patterns, summary, trends, values, words)
from tableprofile.functions.dates import parse_date
from tableprofile.operators.dictionary import Dictionary, built_in
from tableprofile.plans.cuts import packed, scratch_folder, small_side, with_row_id
from tableprofile.sources import readers, sinks
from tableprofile.sources.nested import flatten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the sample tables. UTC keeps dates equal on every machine."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, *tables: str) -> Callable:
    """Register a function of DataFrames under a name, bound to the tables it reads."""
    def register(fn: Callable[..., DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(*[load(spark, sf_dir, t) for t in tables])
        return fn
    return register


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their labels, null where there is none."""
    return documents.join(labels, "doc_id", "left")


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    """Round what depends on the order of a floating-point sum."""
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- summaries and keys -------------------------------------------------------------------

query("field_summary", "orders")(summary.field_summary)
query("field_summary_lineitem", "lineitem")(summary.field_summary)
query("field_summary_nulls", "documents", "labels")(lambda d, l: summary.field_summary(labelled(d, l)))
query("field_summary_approx", "lineitem")(lambda df: summary.field_summary(df, approx=True))
query("coverage", "documents", "labels")(lambda d, l: summary.coverage(labelled(d, l)))
query("dataset_stats", "lineitem")(summary.dataset_stats)
query("detect_keys", "orders")(summary.detect_keys)
query("check_composite_key_valid", "conversations")(lambda df: summary.check_composite_key(df, ["conv_id", "turn"]))
query("check_composite_key_invalid", "lineitem")(
    lambda df: summary.check_composite_key(df, ["l_orderkey", "l_linenumber"]))
query("unique_key_count", "documents", "labels")(
    lambda d, l: summary.unique_key_count(labelled(d, l), ["doc_id", "quality"]))
query("drop_nulls", "documents", "labels")(
    lambda d, l: summary.drop_nulls(labelled(d, l), ["quality", "toxic"]).select("doc_id", "quality", "toxic"))

# --- values -------------------------------------------------------------------------------

query("top_values", "orders")(values.top_values)
query("top_values_nulls", "documents", "labels")(
    lambda d, l: values.top_values(labelled(d, l), ["lang", "source", "quality", "toxic"]))
query("top_values_documents", "documents")(values.top_values)
query("unique_values", "customer")(lambda df: values.unique_values(df, "c_name"))
query("top_values_per_key", "orders")(
    lambda df: values.top_values_per_key(df, ["o_custkey"], ["o_orderstatus", "o_orderpriority"], "o_orderkey"))
query("chart_rows", "documents", "labels")(
    lambda d, l: values.chart_rows(labelled(d, l), ["lang", "source", "text", "quality"]))

# --- kinds and dates ----------------------------------------------------------------------


def orders_with_text_dates(orders: DataFrame) -> DataFrame:
    return orders.withColumn("order_day", F.date_format("o_orderdate", "MM/dd/yyyy"))


query("field_kinds", "orders")(lambda df: kinds.field_kinds(orders_with_text_dates(df), row_id="o_orderkey"))
query("field_kinds_documents", "documents", "labels")(lambda d, l: kinds.field_kinds(labelled(d, l), row_id="doc_id"))
query("detect_dates", "orders")(lambda df: kinds.detect_dates(orders_with_text_dates(df), row_id="o_orderkey"))


def _trend(period: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: trends.trend(df, "o_orderdate", period).withColumn("period", F.col("period").cast("string"))


for _period in ("day", "week", "month", "quarter", "year"):
    query(f"trend_{_period}", "orders")(_trend(_period))
query("trend_events", "events")(
    lambda df: trends.trend(df, "ts", "day").withColumn("period", F.col("period").cast("string")))
query("trend_text_dates", "orders")(
    lambda df: trends.trend(orders_with_text_dates(df), "order_day", "month")
                     .withColumn("period", F.col("period").cast("string")))
query("date_listing", "orders")(lambda df: trends.date_listing(orders_with_text_dates(df), "order_day"))

MIXED_DATES = ["yyyy-MM-dd", "M/d/yyyy H:mm", "MMMM d, yyyy H:mm", "yyyy-M-d h:mm:ss a", "dd MMM yyyy HH:mm", "d-MMM-yy", "EEEE, MMM d, yyyy"]


@query("mixed_dates", "orders")
def _mixed_dates(df: DataFrame) -> DataFrame:
    """Dates written in many ways, read again; is the whole a date column?"""
    text = F.coalesce(*[F.when(F.col("o_orderkey") % len(MIXED_DATES) == i, F.date_format("o_orderdate", f)) for i, f in enumerate(MIXED_DATES)])
    given = df.select("o_orderkey", text.alias("written"), F.col("o_orderpriority").alias("other"))
    found = kinds.detect_dates(given, ["written", "other"], "o_orderkey").groupBy().pivot("field", ["written", "other"]).agg(F.max("is_date"))
    return given.select("o_orderkey", F.to_date(parse_date(F.col("written"))).alias("day")).join(F.broadcast(found), F.lit(True))


# --- words and distributions --------------------------------------------------------------

query("word_counts", "documents")(lambda df: words.word_counts(df, "text"))
query("word_pairs", "documents")(lambda df: words.word_counts(df, "text", pairs=True, top=None))
query("histogram_30", "lineitem")(lambda df: histograms.histogram(df, "l_extendedprice", 30))
query("histograms", "lineitem")(lambda df: histograms.histograms(df))
query("outlier_histograms", "events")(lambda df: histograms.outlier_histograms(df, ["user_id", "value"]))


@query("insights", "orders")
def _insights(df: DataFrame) -> DataFrame:
    """(field, kind, name, rows): every table of every field with the number of its rows."""
    found = insights.insights(orders_with_text_dates(df), row_id="o_orderkey", keys=["o_custkey"])
    parts = [table.agg(F.lit(f).alias("field"), F.lit(one.kind).alias("kind"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
             for f, one in found.items() for name, table in one.tables.items() if name in ("histogram", "top_values", "unique_values", "chart", "trend_day")]
    return reduce(DataFrame.unionByName, parts)


query("histogram_50", "lineitem")(lambda df: histograms.histogram(df, "l_quantity", 50))
query("outlier_histogram", "events")(lambda df: histograms.outlier_histogram(df, "value", 50))
query("box_stats", "events")(lambda df: histograms.box_stats(df, "value"))

# --- filters ------------------------------------------------------------------------------

query("project", "part")(lambda df: filters.project(df, ["p_partkey", "p_brand"]))
query("filter_equals", "part")(
    lambda df: filters.apply_filters(df, {"p_brand": {"type": "equals", "values": ["Brand#2", "Brand#4"]}}))
query("filter_contains", "part")(
    lambda df: filters.apply_filters(df, {"p_name": {"type": "contains", "value": "RING"}}))
query("filter_starts_with", "part")(
    lambda df: filters.apply_filters(df, {"p_type": {"type": "starts_with", "value": "eco"}}))
query("filter_regex", "part")(
    lambda df: filters.apply_filters(df, {"p_brand": {"type": "regex", "value": r"brand#\D*1\d"}}))
query("filter_range", "part")(
    lambda df: filters.apply_filters(df, {"p_size": {"type": "range", "min": 10, "max": 20}}))
query("filter_less_than", "orders")(
    lambda df: filters.apply_filters(df, {"o_totalprice": {"type": "less_than", "value": 50000.0}})
                      .select("o_orderkey", "o_totalprice"))
query("filter_greater_than", "orders")(
    lambda df: filters.apply_filters(df, {"o_totalprice": {"type": "greater_than", "value": 450000.0}})
                      .select("o_orderkey", "o_totalprice"))
query("filter_and", "lineitem")(
    lambda df: filters.apply_filters(df, {
        "l_returnflag": {"type": "equals", "values": ["R"]},
        "l_quantity": {"type": "range", "min": 5.0, "max": 15.0},
        "l_extendedprice": {"type": "greater_than", "value": 60000.0}}).select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
query("filter_choices", "part")(lambda df: filters.filter_choices(df, "p_type"))
query("filter_bounds", "lineitem")(
    lambda df: rounded(filters.filter_bounds(df, ["l_quantity", "l_extendedprice", "l_linenumber"]), "mean"))

# --- patterns -----------------------------------------------------------------------------

query("pattern_report", "customer")(lambda df: patterns.pattern_report(df, row_id="c_custkey"))
query("pattern_report_orders", "orders")(lambda df: patterns.pattern_report(df, row_id="o_orderkey"))
query("top_pattern", "customer")(lambda df: patterns.top_pattern(df, row_id="c_custkey"))


def _tokens_of_documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode(F.split("text", r"[\s,;()]+")).alias("token"))


query("known_formats", "documents")(lambda df: patterns.known_formats(_tokens_of_documents(df), "token"))
query("known_formats_hosts", "pages")(
    lambda df: patterns.known_formats(df.select(F.regexp_extract("url", "://([^/]+)", 1).alias("host")), "host"))

# --- single-column outliers ---------------------------------------------------------------

query("outlier_summary", "lineitem")(lambda df: rounded(outliers.outlier_summary(df), "mean", "std_dev", "iqr"))
query("outlier_summary_events", "events")(
    lambda df: rounded(outliers.outlier_summary(df, ["event_id", "user_id", "value"]), "mean", "std_dev", "iqr"))
query("outlier_rows_zscore", "events")(lambda df: outliers.outlier_rows(df, "value", "zscore", "event_id"))
query("outlier_rows_iqr", "events")(lambda df: outliers.outlier_rows(df, "value", "iqr", "event_id"))
query("outlier_export", "events")(lambda df: outliers.outlier_export(df, "value", "event_id"))
query("outlier_overview", "events")(
    lambda df: outliers.outlier_overview(outliers.outlier_summary(df, ["event_id", "user_id", "value"])))
query("outlier_flags", "events")(
    lambda df: outliers.outlier_flags(outliers.outlier_summary(df, ["event_id", "user_id", "value"])))



def _partly_eligible(d: DataFrame, l: DataFrame) -> DataFrame:
    """One column with a single value, two that are mostly null, and two that may be judged."""
    return labelled(d, l).select("doc_id", "n_chars", "quality", "toxic", F.lit(7).alias("same"))


query("outlier_eligible", "documents", "labels")(lambda d, l: rounded(outliers.outlier_summary(_partly_eligible(d, l)), "mean", "std_dev", "iqr"))

# --- multi-column outliers ----------------------------------------------------------------

CUSTOMER = ["c_custkey", "c_nationkey", "c_acctbal"]


def _customer(df: DataFrame) -> features.Features:
    return features.features(df, "c_custkey", CUSTOMER)


def _detection(df: DataFrame) -> consensus.Detection:
    return consensus.detect(df, "c_custkey", CUSTOMER)


query("standardise", "customer")(
    lambda df: rounded(features.standardise(df, "c_custkey", CUSTOMER[1:]), *CUSTOMER[1:], places=6))
query("dbscan_noise", "customer")(lambda df: dbscan.dbscan_noise(_customer(df), eps=0.2))
query("dbscan_noise_default", "events")(
    lambda df: dbscan.dbscan_noise(features.features(df, "event_id", ["user_id", "value"])))


FIVE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
#: Four columns and three that hold the same value in nearly all rows.
NEARLY_CONSTANT = {"l_partkey": "l_partkey", "l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "l_tax",
                   "most": "CAST(l_quantity >= 50 AS INT)", "dear": "CAST(l_extendedprice >= 100000 AS INT)", "late": "CAST(l_linenumber >= 7 AS INT)"}


def _noise_rows(df: DataFrame, columns: list[str], eps: float) -> DataFrame:
    """The noise of a table without a key, as its rows."""
    numbered = with_row_id(df.select("l_orderkey", "l_linenumber", *columns))
    noise = packed(dbscan.dbscan_noise(features.features(numbered, "row_id", columns), eps))
    return numbered.join(small_side(noise), "row_id", "left_semi").select("l_orderkey", "l_linenumber", *columns)


query("dbscan_noise_five", "lineitem")(lambda df: _noise_rows(df, FIVE, 0.35))
query("dbscan_noise_seven", "lineitem")(lambda df: _noise_rows(
    df.selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {c}" for c, e in NEARLY_CONSTANT.items()]), list(NEARLY_CONSTANT), 0.25))
query("lof_outliers", "customer")(lambda df: lof.lof_outliers(_customer(df)))
query("lof_scores", "supplier")(
    lambda df: rounded(lof.lof_scores(features.features(df, "s_suppkey", ["s_nationkey", "s_acctbal"])), "lof"))
query("iforest_outliers", "customer")(lambda df: isolation_forest.isolation_outliers(_customer(df)))
query("kmeans_outliers", "customer")(lambda df: kmeans.kmeans_outliers(_customer(df)))
query("best_k", "customer")(lambda df: kmeans.best_k(_customer(df)))
query("method_summary", "supplier")(lambda df: consensus.method_summary(_supplier(df)))
query("consensus", "supplier")(lambda df: consensus.consensus(_supplier(df)))
query("method_ranking", "supplier")(lambda df: consensus.method_ranking(_supplier(df)))
query("labelled_points", "supplier")(lambda df: consensus.labelled_points(_supplier(df)))
query("all_outliers", "supplier")(lambda df: consensus.all_outliers(_supplier(df)))


def _by_value(df: DataFrame) -> consensus.Detection:
    """Methods that agree with SQL to the row: z-score and IQR of the event value."""
    found = {name: outliers.outlier_rows(df, "value", how, "event_id").withColumnRenamed("event_id", "row_id")
             for name, how in (("Z-score", "zscore"), ("IQR", "iqr"))}
    return consensus.combine(features.features(df, "event_id", ["user_id", "value"]), found)


query("method_summary_value", "events")(lambda df: consensus.method_summary(_by_value(df)))
query("consensus_value", "events")(lambda df: consensus.consensus(_by_value(df)))
query("method_ranking_value", "events")(lambda df: consensus.method_ranking(_by_value(df)))
query("labelled_points_value", "events")(lambda df: consensus.labelled_points(_by_value(df)))
query("all_outliers_value", "events")(lambda df: consensus.all_outliers(_by_value(df)))


def _with_far(df: DataFrame) -> DataFrame:
    """Customers, and five more whose balance and nation lie far from all others."""
    far = df.where("c_custkey BETWEEN 1 AND 5").select((-F.col("c_custkey")).alias("c_custkey"), (F.col("c_nationkey") + 500).alias("c_nationkey"),
                                            (F.abs("c_acctbal") * 40 + 300_000).alias("c_acctbal"))
    return df.select("c_custkey", "c_nationkey", "c_acctbal").union(far)


def _far_check(flagged: DataFrame, rows: int) -> DataFrame:
    """(rows, share_holds: at most a tenth and one row, far_found: all five far rows)."""
    return flagged.agg(F.lit(rows).cast("long").alias("rows"), (F.count("*") <= 0.1 * rows + 1).alias("share_holds"),
                       (F.count(F.when(F.col("row_id").cast("long") < 0, 1)) == 5).alias("far_found"))


def _far(df: DataFrame, method: Callable) -> DataFrame:
    f = features.features(_with_far(df), "c_custkey", ["c_nationkey", "c_acctbal"])
    return _far_check(method(f), f.count)


query("iforest_far", "customer")(lambda df: _far(df, isolation_forest.isolation_outliers))
query("best_k_range", "customer")(lambda df: kmeans.best_k(_customer(df)).agg(
    F.count("*").alias("tried"), (F.count(F.when(F.col("best"), 1)) == 1).alias("one_best"),
    (F.max("silhouette") == F.max(F.when(F.col("best"), F.col("silhouette")))).alias("best_is_highest")))
query("kmeans_share", "customer")(lambda df: _far_check(kmeans.kmeans_outliers(_customer(df)), df.count()).select("rows", "share_holds"))


def _planted(df: DataFrame) -> features.Features:
    """Customers in three clusters far apart, by their nation; inside one they spread by balance and number."""
    group = F.col("c_nationkey") % 3
    return features.features(df.select("c_custkey", (group * 40 + F.col("c_acctbal") / 1000).alias("x"),
                                       (F.when(group == 1, 50.0).otherwise(0.0) + F.col("c_custkey") % 97 / 10).alias("y")), "c_custkey", ["x", "y"])


query("kmeans_planted", "customer")(lambda df: kmeans.kmeans_outliers(_planted(df)))
query("best_k_planted", "customer")(lambda df: rounded(kmeans.best_k(_planted(df)).where("best"), "silhouette", places=6))


@query("field_summary_estimate", "lineitem")
def _estimates(df: DataFrame) -> DataFrame:
    """(field, close): is the estimated number of values within 5 % of the exact one?"""
    exact = summary.field_summary(df).select("field", F.col("distinct_values").alias("exact"))
    about = summary.field_summary(df, approx=True).select("field", F.col("distinct_values").alias("about"))
    return exact.join(about, "field").select("field", (F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


def _supplier(df: DataFrame) -> consensus.Detection:
    return consensus.detect(df, "s_suppkey", ["s_nationkey", "s_acctbal"])


# --- extraction ---------------------------------------------------------------------------

LICENCES = ["license", "Apache License", "MIT", "apache", "Apache"]
PARTS = Dictionary({"Product": ["widget", "Bolt", "ring"], "Colour": ["red", "blue", "large red"]})
TEXT_TERMS = Dictionary({"Licence": LICENCES, "Function word": ["de", "und", "the"]})

query("extract_matches", "documents")(
    lambda df: extraction.extract_matches(df, TEXT_TERMS, "doc_id", ["text", "lang"]))


def _flat(found: DataFrame) -> DataFrame:
    return found.withColumn("found", F.array_join("found", ", ")).withColumn("evidence", F.array_join("evidence", "|"))


query("extract_summary", "documents")(lambda df: _flat(extraction.extract_summary(df, TEXT_TERMS, row_id="doc_id")))


@query("extract_split", "documents")
def _split(df: DataFrame) -> DataFrame:
    """The summary of each category by itself, under the category's name."""
    parts = extraction.split_by_category(_flat(extraction.extract_summary(df, TEXT_TERMS, row_id="doc_id")), TEXT_TERMS)
    return reduce(DataFrame.unionByName, [part.withColumn("split", F.lit(c)) for c, part in parts.items()])


#: Categories added, replaced and taken away.
MANAGED = TEXT_TERMS.add("Language", ["la", " el ", "LA"]).add("Gone", ["die"]).replace("Function word", ["und", "der"]).remove("Gone")
query("extract_managed", "documents")(lambda df: extraction.extract_matches(df, MANAGED, "doc_id", ["text"]))
query("extract_built_in", "documents")(
    lambda df: _flat(extraction.extract_summary(df, built_in(["France", "India", "Peru"]), row_id="doc_id")))
query("extract_custom", "part")(lambda df: _flat(extraction.extract_summary(df, PARTS, row_id="p_partkey")))
query("joined_terms", "part")(
    lambda df: extraction.extract_matches(
        df.withColumn("p_name", F.when(F.col("p_size") > 25, F.regexp_replace("p_name", " ", "")).otherwise(F.col("p_name"))),
        Dictionary({"Name": ["small ring", "Red Widget"]}), "p_partkey", ["p_name"], match_joined=True))

# --- countries ----------------------------------------------------------------------------

# Names and rounded coordinates of a few countries, attached to the nations by key.
PLACES = [("France", 46.0, 2.0), ("Germany", 51.0, 9.0), ("India", 20.0, 77.0), ("Peru", -10.0, -76.0),
          ("Kenya", 1.0, 38.0)]
SPELLINGS = ["France", "GERMANY", "Indiaa", "peru", "Keniya", "Atlantis"]


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLACES, "country string, lat double, lon double")


def with_country(df: DataFrame, key: str) -> DataFrame:
    """A country name per row, in several spellings, derived from the nation key."""
    names = F.array(*[F.lit(n) for n in SPELLINGS])
    return df.withColumn("country", F.element_at(names, (F.col(key) % len(SPELLINGS) + 1).cast("int")))


def _by_country(customer: DataFrame) -> DataFrame:
    return with_country(customer, "c_nationkey").groupBy("country").agg(F.count(F.lit(1)).alias("n"))


query("country_coverage", "customer")(
    lambda df: extraction.country_coverage(with_country(df, "c_nationkey"), [p[0] for p in PLACES], ["country", "c_name"]))
query("geo_match", "customer")(
    lambda df: geo.match_countries(with_country(df, "c_nationkey"), "country", dimension(df.sparkSession), fuzzy=False))
query("geo_fuzzy", "customer")(
    lambda df: geo.match_countries(with_country(df, "c_nationkey"), "country", dimension(df.sparkSession)))


def _misspelt(part: DataFrame) -> DataFrame:
    """Part names with a letter lost or doubled, words in other order, or several of these."""
    at = F.col("p_partkey") % F.length("p_name") + 1
    lost = F.concat(F.expr("left(p_name, CAST(p_partkey % length(p_name) AS INT))"), F.substr("p_name", at.cast("int") + F.lit(1)))
    doubled = F.concat(F.expr("left(p_name, CAST(p_partkey % length(p_name) AS INT) + 1)"), F.substr("p_name", at.cast("int")))
    swapped = F.concat_ws(", ", F.substring_index("p_name", " ", -1), F.upper(F.substring_index("p_name", " ", 1)))
    kind = F.col("p_partkey") % 5
    return part.select(F.when(kind == 0, lost).when(kind == 1, doubled).when(kind == 2, swapped).when(kind == 3, F.concat("p_brand", F.lit(" "), "p_name"))
                       .otherwise(F.substr(lost, F.lit(2))).alias("country"))


query("similar_parts", "part")(lambda df: geo.match_countries(_misspelt(df), "country", df.groupBy(F.col("p_name").alias("country")).agg(
    F.min("p_size").cast("double").alias("lat"), F.min("p_retailprice").alias("lon"))))
query("map_layer", "customer")(
    lambda df: rounded(geo.map_layer(_by_country(df), "country", dimension(df.sparkSession), "n"), "radius"))
query("map_lines", "customer")(
    lambda df: geo.map_lines(geo.map_layer(_by_country(df), "country", dimension(df.sparkSession), "n")))
query("heat_weights", "customer")(
    lambda df: geo.heat_weights(geo.map_layer(_by_country(df), "country", dimension(df.sparkSession), "n")))

# --- nested data --------------------------------------------------------------------------

query("flatten_json", "events")(
    lambda df: flatten(df.select("event_id", F.from_json("props", "k long").alias("props"))))


# --- keywords from tables -----------------------------------------------------------------------


def _table_terms(benchmark: DataFrame, part: DataFrame) -> DataFrame:
    """Two neighbouring words of every benchmark text, and every part by name and number."""
    words = F.split("text", " ")
    pairs = benchmark.select(words.alias("w")).select(F.explode(F.transform(F.slice("w", 2, 1 << 30), lambda x, i: F.concat(F.get("w", i), F.lit(" "), x))).alias("keyword"))
    return pairs.select(F.lit("phrase").alias("category"), "keyword").union(
        part.select(F.lit("part"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))))


query("extract_table", "documents", "benchmark", "part")(lambda df, benchmark, part: keyword_table.extract_matches_of(
    df, _table_terms(benchmark, part), "doc_id", ["text"]))
query("extract_table_shuffled", "documents", "benchmark", "part")(lambda df, benchmark, part: keyword_table.extract_matches_of(
    df, _table_terms(benchmark, part), "doc_id", ["text"], broadcast_bytes=0))
query("extract_table_counts", "documents", "benchmark", "part")(lambda df, benchmark, part: keyword_table.extract_counts_of(
    df, _table_terms(benchmark, part), "doc_id", ["text", "lang"]).drop("evidence"))


# --- sources and sinks: what is written comes back --------------------------------------------


@query("csv_round_trip", "documents")
def _csv(df: DataFrame) -> DataFrame:
    """Texts with line breaks and quotes, through files."""
    path = scratch_folder(df.sparkSession, "documents.csv")
    sinks.write_csv(df, path)
    return readers.read_any(df.sparkSession, path)


@query("raw_export", "orders")
def _raw_export(df: DataFrame) -> DataFrame:
    path = sinks.export_raw(df, ["o_orderkey", "o_orderstatus", "o_totalprice"], scratch_folder(df.sparkSession), "orders")
    return readers.read_csv(df.sparkSession, path)


@query("session_round_trip", "customer", "nation")
def _session(df: DataFrame, nation: DataFrame) -> DataFrame:
    """The table, beside the choices that were saved with it."""
    chosen = sinks.Session(primary_keys=["c_custkey"], countries=[r.n_name for r in nation.orderBy("n_name").limit(3).collect()])
    table, back = sinks.restore_session(df.sparkSession, sinks.save_session(df, chosen, scratch_folder(df.sparkSession), "customer"))
    return table.select("*", F.lit(back.primary_keys[0]).alias("key"), F.lit(",".join(back.countries)).alias("countries"))


@query("json_lines", "events")
def _json_lines(df: DataFrame) -> DataFrame:
    path = scratch_folder(df.sparkSession, "events.jsonl")
    df.select("event_id", "event_type", "value", F.from_json("props", "k long").alias("props")).write.json(path)
    return readers.read_any(df.sparkSession, path)


@query("json_document", "part")
def _json_document(df: DataFrame) -> DataFrame:
    """Arrays of objects, one document a file."""
    path = scratch_folder(df.sparkSession, "part.json")
    one = F.to_json(F.struct("p_partkey", "p_name", F.struct("p_brand", "p_size").alias("made")))
    df.groupBy(F.pmod("p_partkey", F.lit(16)).alias("file")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(one), ",\n"), F.lit("]")).alias("value")).write.partitionBy("file").option("lineSep", "\n").text(path)
    return readers.read_json(df.sparkSession, f"{path}/*", lines=False)


@query("xml_rows", "supplier")
def _xml_rows(df: DataFrame) -> DataFrame:
    path = scratch_folder(df.sparkSession, "supplier.xml")
    df.select(*[F.col(c).cast("string") for c in df.columns]).write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(path)
    return readers.read_any(df.sparkSession, path)


@query("sql_source", "orders")
def _sql_source(df: DataFrame) -> DataFrame:
    df.createOrReplaceTempView("tableprofile_orders")
    return readers.read_sql(df.sparkSession, "SELECT o_orderstatus, count(*) AS n FROM tableprofile_orders GROUP BY o_orderstatus")
