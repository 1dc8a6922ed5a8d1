"""Quality rules: counts of a text, and the likelihood ratio of its hashed n-grams.

Two multinomials over hashed n-grams are counted, one over a trusted sample, one over all documents.
A text's score is the mean of log p(trusted) - log p(raw) over its n-grams; every document is kept
or not by one fixed threshold, without drawing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableprofile.llm.common import pick
from tableprofile.llm.text_arrays import SPACES, U, Words, range_hashes, row_windows, slices, words_of

BUCKETS = 1 << 16
TRUSTED_ROWS = 20_000      # labelled rows the trusted model is fitted on, at most
PRIOR = 5.0
THRESHOLD = -0.4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams of 1 to n words."""
    rows, values = [words.row], [words.hash]
    for size in range(2, n + 1):
        row, value = row_windows(words, size)
        rows.append(row)
        values.append(value)
    return np.concatenate(rows), (np.concatenate(values) % U(BUCKETS)).astype(np.int64)


def trusted_sample(labels: DataFrame, id: str = "doc_id", quality: str = "quality", rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of at most `rows` rows labelled 1, those with the smallest hashes; null ids are left out."""
    ids = pick(labels, id=id, quality=quality).where("quality = 1 AND id IS NOT NULL").select("id").distinct()
    return ids.orderBy(F.xxhash64("id"), "id").limit(rows)


def ratio_table(df: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", n: int = 1) -> np.ndarray:
    """log p(trusted) - log p(raw) of each bucket: the logarithm of trusted counts over those that the
    raw shares let expect, PRIOR added to both, so that what was hardly seen says little.

    Raw counts are of all rows of df; trusted counts of the rows whose id is in `trusted`, which
    must be of bounded size: it is broadcast. What comes to the driver has one row per bucket.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            chosen = np.asarray(batch.column("trusted").to_numpy(zero_copy_only=False), bool)
            for first, end, data, at in slices(batch.column("text")):
                row, bucket = _ngrams(words_of(data, at), n)
                counts[0] += np.bincount(bucket, minlength=BUCKETS)
                counts[1] += np.bincount(bucket[chosen[first:end][row]], minlength=BUCKETS)
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen])],
                                         names=["bucket", "raw", "trusted"])

    marked = pick(df, id=id, text=text).join(
        F.broadcast(trusted.select("id").distinct().withColumn("trusted", F.lit(True))), "id", "left")
    counted = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(
        count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    counts = np.zeros((2, BUCKETS))
    rows = counted.toArrow()
    for i, name in enumerate(("raw", "trusted")):
        counts[i, rows["bucket"].to_numpy()] = rows[name].to_numpy()
    raw, chosen = counts
    expected = raw * (chosen.sum() / max(1, raw.sum()))
    return np.log((chosen + PRIOR) / (expected + PRIOR))


def base_counts(words: Words, data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The rule columns of some texts."""
    n = len(at) - 1
    row_of_byte = np.repeat(np.arange(n), np.diff(at))
    chars = ~SPACES[data] & ((data & 0xC0) != 0x80)
    # lines: cut at \n and at the ends of texts
    cuts = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([at[:-1], cuts + 1]), kind="stable")
    ends = np.sort(np.concatenate([cuts, at[1:]]), kind="stable")
    line_row = np.repeat(np.arange(n), np.bincount(row_of_byte[cuts], minlength=n) + 1)
    filled = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    line_row, value = line_row[filled], range_hashes(data, starts[filled], ends[filled])
    order = np.lexsort((value, line_row))
    line_row, value = line_row[order], value[order]
    again = (line_row[1:] == line_row[:-1]) & (value[1:] == value[:-1])
    # words of 3-word windows that are found twice
    row, window = row_windows(words, 3)
    place = np.flatnonzero(words.row[:-2] == words.row[2:]) if len(words.row) > 2 else np.zeros(0, np.int64)
    order = np.lexsort((window, row))
    same = (row[order][1:] == row[order][:-1]) & (window[order][1:] == window[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    inside = np.zeros(len(words.row), bool)
    for i in range(3):
        inside[place[order[twice]] + i] = True
    return {"n_words": words.per_row, "word_chars": np.bincount(row_of_byte[chars], minlength=n),
            "n_symbols": np.bincount(row_of_byte[_SYMBOL[data]], minlength=n),
            "n_dup_lines": np.bincount(line_row[1:][again], minlength=n),
            "n_repeat_words": np.bincount(words.row[inside], minlength=n)}


def quality_rules(df: DataFrame, ratios: np.ndarray, id: str = "doc_id", text: str = "text", n: int = 1,
                  threshold: float = THRESHOLD, min_words: int = MIN_WORDS,
                  max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    base_failed: fewer than min_words words, or more than max_repeat_percent of the words stand in
    3-word windows found at least twice. kept: not base_failed and score >= threshold; a text without
    n-grams scores 0. `ratios` is the table of `ratio_table` for the same n. Null text has no words.
    Repeated rows each give a row; other columns are not read. One scan, no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(ratios)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column("text")):
                words = words_of(data, at)
                counts = base_counts(words, data, at)
                row, bucket = _ngrams(words, n)
                score = np.bincount(row, shared.value[bucket], end - first) / np.maximum(1, np.bincount(row, minlength=end - first))
                failed = (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > max_repeat_percent * counts["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, end - first), *(pa.array(counts[c].astype(np.int64)) for c in names),
                     pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                    names=["id", *names, "base_failed", "kept", "score"])

    return pick(df, id=id, text=text).mapInArrow(
        judge, f"id {df.schema[id].dataType.simpleString()}, {', '.join(c + ' long' for c in names)}, "
               "base_failed boolean, kept boolean, score double").withColumnRenamed("id", id)
