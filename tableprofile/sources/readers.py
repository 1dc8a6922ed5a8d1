"""Loading a table: CSV, JSON, JSON lines, XML, Parquet, or the result of a SQL query."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tableprofile.functions.columns import quoted
from tableprofile.sources.nested import flatten
from tableprofile.sources.split_csv import breaks_in_quotes, read_records
from tableprofile.sources.split_json import array_lines

# Texts that stand for a missing value in CSV files.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
_INT = r"^\s*[+-]?\d+\s*$"
_FLOAT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Inf|infinity|Infinity)\s*$"
_TRUE, _FALSE = ["True", "TRUE", "true"], ["False", "FALSE", "false"]


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """CSV with a header row; a column becomes int, float or bool if all its values fit.

    Everything is read as text and the types are voted on by one aggregate, because Spark's own
    inference would turn date texts into dates and take NA for text. Line breaks inside quotes are
    found by a scan of the lines, and such files too are read by many tasks; multi_line=False
    leaves out the scan.
    """
    splits = None if multi_line is False else breaks_in_quotes(spark, path)
    raw = spark.read.option("header", True).option("escape", '"').csv(path) if splits is None else read_records(spark, path, splits)
    text = raw.select(*[F.when(~quoted(c).isin(NA_TOKENS), quoted(c)).alias(c) for c in raw.columns])
    votes = []
    for i, c in enumerate(raw.columns):
        v = quoted(c)
        votes += [F.count(v).alias(f"n{i}"), F.count(F.when(v.rlike(_INT), v.try_cast("long"))).alias(f"i{i}"),
                  F.count(F.when(v.rlike(_FLOAT), F.lit(1))).alias(f"f{i}"),
                  F.count(F.when(v.isin(_TRUE + _FALSE), F.lit(1))).alias(f"b{i}")]
    if not votes:
        return text
    seen = text.agg(*votes).first()
    typed = []
    for i, c in enumerate(raw.columns):
        v, n = quoted(c), seen[f"n{i}"]
        if n == 0:
            out = v.try_cast("double")
        elif seen[f"i{i}"] == n:
            out = v.try_cast("long")
        elif seen[f"f{i}"] == n:
            out = F.trim(v).try_cast("double")
        elif seen[f"b{i}"] == n:
            out = F.when(v.isin(_TRUE), True).when(v.isin(_FALSE), False)
        else:
            out = v
        typed.append(out.alias(c))
    return text.select(*typed)


def _is_json_lines(spark: SparkSession, path: str) -> bool:
    """Is the first non-empty line a complete object? Judged where the file is read; one flag returns."""
    line = F.trim("value")
    first = spark.read.text(path).where(line != "").select(
        (line.startswith("{") & F.try_parse_json(line).isNotNull()).alias("whole")).first()
    return bool(first and first.whole)


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """A JSON document (array of objects, or one object) or JSON lines, flattened.

    An array is turned into JSON lines by many tasks; JSON lines are split like any text file. Only a
    document that is one object is read by one task per file.
    """
    if lines is None:
        lines = _is_json_lines(spark, path)
    if not lines:
        folder = array_lines(spark, path)
        path, lines = (path, False) if folder is None else (folder, True)
    return flatten(spark.read.option("multiLine", not lines).json(path))


def _xml(spark: SparkSession, tag: str):
    return spark.read.format("xml").option("rowTag", tag).option("excludeAttribute", True) \
                .option("inferSchema", False).option("ignoreSurroundingSpaces", False)


def xml_row_tags(spark: SparkSession, path: str) -> list[str]:
    """Names of the root's children, from the inferred schema of the root element.

    The root is read by one task per file: pass row_tags to read_xml for large files.
    """
    root = re.compile(r"<([A-Za-z_][\w.:-]*)")
    opening = spark.read.text(path).select(
        F.regexp_extract("value", root.pattern, 1).alias("tag")).where(F.col("tag") != "").first()
    if opening is None:
        return []
    return [f.name for f in _xml(spark, opening.tag).load(path).schema.fields if f.name != "_VALUE"]


def _xml_rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    fields = [f.name for f in _xml(spark, tag).load(path).schema.fields if f.name != "_VALUE"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*fields, "_VALUE"]])
    rows = _xml(spark, tag).schema(schema).load(path)
    # only the direct text of a child counts; a child with children of its own arrives as markup
    own = [F.when(~F.ltrim(quoted(n)).startswith("<"), quoted(n)).alias(n) for n in fields]
    if not fields:
        return rows.select(F.col("_VALUE").alias(tag))
    childless = F.lit(True)
    for n in fields:
        childless = childless & quoted(n).isNull()
    lone: list[Column] = []
    if tag not in fields:
        lone = [F.when(childless, F.col("_VALUE")).alias(tag)]
    out = rows.select(*own, *lone)
    # the column of lone texts exists only where there is such an element
    return out if lone and not out.where(quoted(tag).isNotNull()).isEmpty() else out.select(*[quoted(n) for n in fields])


def read_xml(spark: SparkSession, path: str, row_tags: list[str] | None = None) -> DataFrame:
    """One row per child of the root; its children are text columns. A childless child of the
    root gives a row with one column named after it. Attributes are ignored."""
    tags = xml_row_tags(spark, path) if row_tags is None else row_tags
    if not tags:
        raise ValueError(f"no rows in {path}")
    out = _xml_rows(spark, path, tags[0])
    for tag in tags[1:]:
        out = out.unionByName(_xml_rows(spark, path, tag), allowMissingColumns=True)
    return out


def read_sql(spark: SparkSession, query: str) -> DataFrame:
    """The result of a SQL query over the session's catalog."""
    return spark.sql(query)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Choose the reader by file suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix in ("json", "jsonl", "ndjson"):
        return read_json(spark, path, lines=None if suffix == "json" else True)
    if suffix == "xml":
        return read_xml(spark, path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")
