"""Keyword extraction from text columns."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.functions.columns import pick_fields, text_columns
from tableprofile.operators.dictionary import Dictionary, Entry
from tableprofile.plans.longform import filled_counts, to_long

_RUNS = r"[^\p{L}]+"
_ENTRY = "struct<category:string,keyword:string,form:string,pattern:string>"


def _as_json(entries: list[Entry]) -> list[dict]:
    return [{"category": e.category, "keyword": e.keyword, "form": e.form, "pattern": e.pattern} for e in entries]


def found_keywords(text: Column, entries: list[Entry]) -> Column:
    """array<struct<category, keyword>> of the entries found in a text, ignoring case.

    A keyword can only match where its anchor is a whole letter run, so one hash intersection
    of the text's letter runs with the anchors leaves the few entries whose regex must run.
    Everything stays inside the row: no explode of the words, no join, no shuffle. The
    dictionary is a constant of the plan; it is typed by people, not read from data.
    """
    by_anchor: dict[str, list[Entry]] = defaultdict(list)
    bare = []
    for e in entries:
        by_anchor[e.anchor].append(e) if e.anchor else bare.append(e)
    lowered = F.lower(text)
    parts = []
    if by_anchor:
        lookup = F.from_json(F.lit(json.dumps({a: _as_json(es) for a, es in by_anchor.items()})),
                             f"map<string,array<{_ENTRY}>>")
        seen = F.array_intersect(F.from_json(F.lit(json.dumps(sorted(by_anchor))), "array<string>"), F.split(lowered, _RUNS))
        candidates = F.flatten(F.transform(seen, lambda a: F.element_at(lookup, a)))
        parts.append(F.filter(candidates, lambda e: F.regexp_like(lowered, e.pattern)))
    if bare:
        table = F.from_json(F.lit(json.dumps(_as_json(bare))), f"array<{_ENTRY}>")
        parts.append(F.filter(table, lambda e: F.contains(lowered, e.form) & F.regexp_like(lowered, e.pattern)))
    if not parts:
        return F.lit(None).cast("array<struct<category:string,keyword:string>>")
    found = F.concat(*parts) if len(parts) > 1 else parts[0]
    # a keyword may be found under two forms
    return F.array_distinct(F.transform(found, lambda e: F.struct(
        e.category.alias("category"), e.keyword.alias("keyword"))))


def _found(df: DataFrame, dictionary: Dictionary, fields: list[str] | None, row_id: str | None,
           match_joined: bool) -> DataFrame:
    fields = text_columns(df) if fields is None else pick_fields(df, fields)
    long = to_long(df, fields, row_id).where(F.col("value").isNotNull())
    return long.withColumn("found", found_keywords(F.col("value"), dictionary.entries(match_joined)))


def extract_matches(df: DataFrame, dictionary: Dictionary, row_id: str, fields: list[str] | None = None,
                    match_joined: bool = False) -> DataFrame:
    """(row_id, field, category, keyword), once per row, field and keyword."""
    found = _found(df, dictionary, fields, row_id, match_joined)
    return found.select("row_id", "field", F.inline("found"))


def extract_summary(df: DataFrame, dictionary: Dictionary, fields: list[str] | None = None,
                    row_id: str | None = None, match_joined: bool = False) -> DataFrame:
    """(field, category, found, matched_records, coverage_pct, evidence, records_processed).

    One scan: each matching row emits its keywords plus one entry per category (keyword null)
    that counts the row once, so distinct rows need no distinct. Map-side combine leaves one
    row per field and keyword. Evidence is the text with the smallest row_id, or the smallest
    text without a row_id. Coverage is over all rows.
    """
    fields = text_columns(df) if fields is None else pick_fields(df, fields)
    found = _found(df, dictionary, fields, row_id, match_joined)
    keyword = "struct<category:string,keyword:string>"
    rows = F.array_distinct(F.transform("found", lambda m: F.struct(
        m.category.alias("category"), F.lit(None).cast("string").alias("keyword"))))
    hits = found.select(*(["row_id"] if row_id else []), "field", "value",
                        F.inline(F.concat(F.col("found").cast(f"array<{keyword}>"), rows.cast(f"array<{keyword}>"))))
    text = F.when(F.col("keyword").isNotNull(), F.col("value"))
    example = F.min_by(text, "row_id") if row_id else F.min(text)
    per_keyword = hits.groupBy("field", "category", "keyword").agg(
        F.count(F.lit(1)).alias("n"), example.alias("example"))
    item = F.when(F.col("keyword").isNotNull(), F.struct("keyword", "example"))
    summary = per_keyword.groupBy("field", "category").agg(   # at most one row per keyword in a group
        F.sort_array(F.collect_list(item)).alias("items"),
        F.max(F.when(F.col("keyword").isNull(), F.col("n"))).alias("matched_records"))
    counted = filled_counts(df, fields)
    return summary.join(F.broadcast(counted), "field").select(   # one row per field
        "field", "category", F.col("items.keyword").alias("found"), "matched_records",
        (F.col("matched_records") / F.col("total") * 100.0).alias("coverage_pct"),
        F.col("items.example").alias("evidence"), F.col("filled").alias("records_processed"))


def split_by_category(summary: DataFrame, dictionary: Dictionary) -> dict[str, DataFrame]:
    return {c: summary.where(F.col("category") == c) for c in dictionary.categories}


def country_coverage(df: DataFrame, countries: list[str], fields: list[str] | None = None) -> DataFrame:
    """(country, coverage_pct, count, fields), highest coverage first.

    The count is of (row, field) pairs, so with several fields coverage may exceed 100.
    """
    found = _found(df, Dictionary({"Countries": countries}), fields, None, False)
    per_field = found.select("field", F.inline("found")).groupBy("keyword", "field").agg(F.count(F.lit(1)).alias("n"))
    per_country = per_field.groupBy(F.col("keyword").alias("country")).agg(
        F.sum("n").alias("count"), F.array_join(F.sort_array(F.collect_set("field")), ", ").alias("fields"))
    return per_country.select(
        "country", F.round(F.col("count") / F.lit(max(1, df.count())) * 100.0, 2).alias("coverage_pct"), "count", "fields",
    ).orderBy(F.desc("coverage_pct"), "country")
