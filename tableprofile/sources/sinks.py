"""CSV exports, and saving and restoring a session."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tableprofile.functions.columns import as_text, pick_fields, quoted, type_labels
from tableprofile.operators.filters import project


def _printable(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: lists of texts are joined, the rest becomes JSON."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out.append(F.array_join(quoted(f.name), ", ").alias(f.name))
        elif type_labels(df)[f.name] == "other":
            out.append(as_text(df, f.name).alias(f.name))
        else:
            out.append(quoted(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header in a directory; single_file is for small result tables only."""
    out = _printable(df)
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (out.repartition(1) if single_file else out).write.options(header=True, escape='"', **kept).csv(path)


def export_raw(df: DataFrame, fields: list[str], folder: str, base: str, now: datetime | None = None) -> str:
    """Write chosen columns, as many files in parallel as there are partitions; returns the path."""
    # File name and time format.
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/{base}-raw-data-export-{stamp}.csv"
    write_csv(project(df, pick_fields(df, fields)), path)
    return path


@dataclass
class Session:
    """What an analyst has chosen: keys, word lists and custom categories."""

    primary_keys: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    compliance: list[str] = field(default_factory=list)
    business_units: list[str] = field(default_factory=list)
    custom_categories: dict[str, list[str]] = field(default_factory=dict)


def save_session(df: DataFrame, session: Session, folder: str, base: str, now: datetime | None = None) -> str:
    """Table as Parquet and the choices as one JSON line beside it; returns the path."""
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/{base}_{stamp}"
    df.write.parquet(f"{path}/table")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(asdict(session)),)], "value string").coalesce(1).write.text(f"{path}/session")
    return path


def restore_session(spark: SparkSession, path: str) -> tuple[DataFrame, Session]:
    saved = json.loads(spark.read.text(f"{path}/session").first().value)
    return spark.read.parquet(f"{path}/table"), Session(**saved)
