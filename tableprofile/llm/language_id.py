"""Language identification by fusing evidence in Bayes' rule.

log P(language | all) = text + log P(declared | language) + log P(suffix | language) + log P(language | host)

* text: mean log likelihood of the text's hashed byte trigrams times their number, at most EVIDENCE.
* declared, suffix: how often each declared language or address suffix goes with each language,
  counted over all rows with the text's own probabilities as weights, 1 added.
* host prior: the same counts by host, smoothed with those of its domain, and these with all rows'.

Besides the languages there is `und`, a uniform model: what fits no language better is undetermined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprofile.functions.columns import quoted
from tableprofile.llm.common import pick, small, written
from tableprofile.llm.text_arrays import LOWER, U, slices, windows

UND = "und"
BUCKETS = 1 << 16
TRAINING_ROWS = 1000       # labelled rows of each language the text model is fitted on, at most
LANGUAGES = 200            # most languages of a model
EVIDENCE = 60.0            # trigrams a text counts for, at most: neighbours are not independent
STRENGTH = 20.0            # rows that a parent's prior is worth
MIN_PROBABILITY = 0.5


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray       # language, bucket


def _trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the byte trigrams inside each text, A-Z as a-z."""
    h = windows(LOWER[data].astype(np.uint64), 3)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = row[:len(h)] == row[2:] if len(h) else np.zeros(0, bool)
    return row[:len(h)][keep], (h[keep] % U(BUCKETS)).astype(np.int64)


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", rows: int = TRAINING_ROWS) -> TextModel:
    """Count trigrams of `rows` labelled rows of each language, those with the smallest hashes of the id.

    Rows with a null id, text or label are left out; no labelled rows: a model without languages.
    """
    given = pick(df, id=id, text=text, label=label).where("id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    chosen = given.select("id", "label").distinct().withColumn("rank", rank).where(F.col("rank") <= rows).select("id", "label").limit(rows * LANGUAGES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist())
            for first, end, data, at in slices(batch.column("text")):
                row, bucket = _trigrams(data, at)
                of = labels[first:end][row]
                for name in set(labels[first:end]):
                    counts[name] = counts.get(name, 0) + np.bincount(bucket[of == name], minlength=BUCKETS)
        for name, c in counts.items():
            seen = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen)), pa.array(seen), pa.array(c[seen])],
                                             names=["label", "bucket", "n"])

    counted = given.join(F.broadcast(chosen), ["id", "label"]).select("text", "label").mapInArrow(
        count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    labels, buckets, n = (counted[c].to_numpy() for c in ("label", "bucket", "n"))
    languages = sorted(set(labels))
    counts = np.full((len(languages) + 1, BUCKETS), 0.5)
    for i, name in enumerate(languages):
        counts[i, buckets[labels == name]] += n[labels == name]
    return TextModel([*languages, UND], np.log(counts / counts.sum(axis=1, keepdims=True)))


def _softmax(values: Column) -> Column:
    weights = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, key: str | None, k: int) -> DataFrame:
    """Sum of the text probabilities by key, as an array."""
    grouped = df.groupBy(key) if key else df.groupBy()
    sums = grouped.agg(*(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)))
    return sums.select(*([key] if key else []), F.array(*(F.coalesce(f"s{i}", F.lit(0.0)) for i in range(k))).alias(f"{key or 'all'}_n"))


def _smoothed(n: Column, parent: Column) -> Column:
    total = F.aggregate(n, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(n, parent, lambda x, q: (x + STRENGTH * q) / (total + STRENGTH))


def identify(df: DataFrame, model: TextModel, id: str = "doc_id", text: Column | str = "text",
             declared: Column | None = None, host: Column | None = None, suffix: Column | None = None,
             min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Per row: id, language, probability, text_language, kept.

    kept: the language is not `und` and its probability is at least min_probability. A null or empty
    text, or one of under three bytes, has no text evidence: it is `und` and not kept, whatever its
    other evidence. Null declared, host or suffix: no such evidence. Ties go to the language first in
    order. Repeated rows each give a row; other columns are not read. The counts by host, domain,
    declared value and suffix are of all rows, summed before the shuffle; a table of them is broadcast
    only if its measured size is small.
    """
    names, k = model.languages, len(model.languages)
    shared = df.sparkSession.sparkContext.broadcast(model.log_p)
    none = F.lit(None).cast("string")
    given = df.select(quoted(id).alias("id"), (quoted(text) if isinstance(text, str) else text).alias("text"),
                      F.lower(none if declared is None else declared).alias("declared"),
                      F.lower(none if host is None else host).alias("host"),
                      F.lower(none if suffix is None else suffix).alias("suffix"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column("text")):
                row, bucket = _trigrams(data, at)
                n = np.bincount(row, minlength=end - first)
                weight = np.minimum(1, EVIDENCE / np.maximum(1, n))
                scores = np.stack([np.bincount(row, shared.value[i][bucket], end - first) * weight for i in range(k)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, end - first) for c in ("id", "declared", "host", "suffix")), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, k * (end - first) + 1, k, dtype=np.int32)), pa.array(scores.ravel()))],
                    names=["id", "declared", "host", "suffix", "n", "t"])

    scored = written(given.mapInArrow(
        score, f"id {df.schema[id].dataType.simpleString()}, declared string, host string, suffix string, n long, t array<double>"))
    scored = scored.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("p", _softmax(F.col("t")))
    counted = scored.where("n > 0")
    every = _sums(counted, None, k).first()["all_n"]
    total = sum(every)
    base = F.array(*(F.lit((x + 1) / (total + k)) for x in every))
    log_p = F.zip_with("t", base, lambda t, b: t + F.log(b))     # without a host: the prior of all rows
    out = scored
    if host is not None:
        hosts = small(written(_sums(counted.where("host IS NOT NULL"), "host", k)), F.length("host") + 8 * k)
        domains = small(written(_sums(counted.where("domain IS NOT NULL"), "domain", k)), F.length("domain") + 8 * k)
        zero = F.array(*(F.lit(0.0) for _ in range(k)))
        out = out.join(hosts, "host", "left").join(domains, "domain", "left")
        prior = _smoothed(F.coalesce("host_n", zero), _smoothed(F.coalesce("domain_n", zero), base))
        log_p = F.zip_with("t", prior, lambda t, q: t + F.log(q))
    for name, column in (("declared", declared), ("suffix", suffix)):
        if column is None:
            continue
        values = written(_sums(counted.where(F.col(name).isNotNull()), name, k))
        n = values.count()
        sums = values.agg(*(F.sum(F.col(f"{name}_n")[i]).alias(f"s{i}") for i in range(k))).first()
        of = F.array(*(F.lit((x or 0.0) + n + 1) for x in sums))
        out = out.join(small(values, F.length(name) + 8 * k), name, "left")
        chance = F.zip_with(F.coalesce(f"{name}_n", F.array(*(F.lit(0.0) for _ in range(k)))), of, lambda x, y: F.log((x + 1) / y))
        log_p = F.when(F.col(name).isNull(), log_p).otherwise(F.zip_with(log_p, chance, lambda a, b: a + b))
    labels = F.array(*(F.lit(x) for x in names))
    best = lambda a: F.element_at(labels, F.array_position(a, F.array_max(a)).cast("int"))
    out = out.withColumn("q", _softmax(log_p))
    language = F.when(F.col("n") == 0, UND).otherwise(best(F.col("q")))
    return out.select(F.col("id").alias(id), language.alias("language"),
                      F.when(F.col("n") == 0, 1.0).otherwise(F.array_max("q")).alias("probability"),
                      F.when(F.col("n") == 0, UND).otherwise(best(F.col("t"))).alias("text_language"),
                      ((language != UND) & (F.array_max("q") >= min_probability)).alias("kept"))


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def page_language(html: Column) -> Column:
    """Primary subtag of the language declared on the html element, or null."""
    found = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)
    return F.when(found != "", F.lower(found))


def url_host(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.lower(found))


def host_suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)
