"""Word frequencies of a text field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.functions.columns import pick_fields, quoted
from tableprofile.plans.cuts import cut

# A short list of our own; callers pass the list they want.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its my no not of on or our "
    "she so that the their them then there they this to was we were what when which who will with you your"
).split()
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"


PAIR_SCORE = 30.0           # log-likelihood ratio from which two words belong together


def word_counts(df: DataFrame, field: str, stop_words: list[str] | None = None, top: int | None = 200, pairs: bool = False,
                pair_score: float = PAIR_SCORE) -> DataFrame:
    """(word, count), most frequent first; top=None keeps every word.

    Words are lower-cased, lose a trailing 's, and must not be all digits. A plural in -s is
    added to its singular when the text has the singular.

    With pairs, two neighbouring words that occur together more often than their own counts explain
    (log-likelihood ratio over pair_score) are an entry of their own, and what the pair counts is taken
    from both words. Neighbours stand in one text, with no stop word between them.

    The raw tokens are counted first, combined map-side; cleaning and plural merging then run
    once per distinct token, on a table the size of the vocabulary. With pairs, both counts are written when
    it is called, so that the texts are read once for words and once for pairs.
    """
    pick_fields(df, [field])
    stops = [w.lower() for w in (STOP_WORDS if stop_words is None else stop_words)]
    tokens = df.select(F.explode(F.regexp_extract_all(F.lower(quoted(field)), F.lit(WORD), F.lit(0))).alias("token"))
    tokens = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    words = tokens.select(_cleaned(F.col("token")).alias("w"), "n").where(_is_word(F.col("w")))
    if stops:
        words = words.where(~F.col("w").isin(stops))
    if pairs:
        words = cut(words)
    merged = _merged(words)
    counts = merged.select("word", "count")
    if pairs:
        counts = _with_pairs(_pairs(df, field, stops), words, counts, pair_score)
    out = counts.orderBy(F.desc("count"), "word")
    return out if top is None else out.limit(top)


def _cleaned(token: Column) -> Column:
    """Without a trailing 's; plain functions, as a pattern for every token of a text is dear."""
    return F.when(token.endswith("'s"), F.left(token, F.length(token) - 2)).otherwise(token)


def _is_word(w: Column) -> Column:
    """Not empty and not all digits; what begins with a to z needs no pattern."""
    return ((w >= "a") & (w < "{")) | ((w != "") & ~w.rlike(r"^\p{Nd}+$"))


def _plural() -> Column:
    """A word in -s is never the singular of another: that one would end in -ss."""
    return F.col("w").endswith("s") & ~F.col("w").endswith("ss") & (F.length("w") > 1)


def _stem() -> Column:
    return F.when(_plural(), F.expr("left(w, length(w) - 1)")).otherwise(F.col("w"))


def _merged(words: DataFrame) -> DataFrame:
    """(stem, word, count) of (w, n): plurals with their singulars."""
    counts = words.groupBy(_stem().alias("stem")).agg(F.sum("n").alias("count"), F.max(~_plural()).alias("singular_seen"))
    return counts.select("stem", F.when(F.col("singular_seen"), F.col("stem")).otherwise(F.concat("stem", F.lit("s"))).alias("word"), "count")


def _pairs(df: DataFrame, field: str, stops: list[str]) -> DataFrame:
    """(one, two, n): neighbouring words, neither of them a stop word, combined map-side."""
    tokens = F.regexp_extract_all(F.lower(quoted(field)), F.lit(WORD), F.lit(0))
    kept = F.filter(F.transform(tokens, _cleaned), _is_word)
    rows = df.select(kept.alias("w")).where(F.size("w") > 1)
    both = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(a.alias("one"), b.alias("two")))
    found = rows.select(F.inline(both))
    if stops:
        found = found.where(~F.col("one").isin(stops) & ~F.col("two").isin(stops))
    return found.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"))


def _likelihood(hits: Column, tries: Column, chance: Column) -> Column:
    least = F.lit(1e-10)
    return F.ln(F.greatest(chance, least)) * hits + F.ln(F.greatest(1 - chance, least)) * (tries - hits)


def _with_pairs(pairs: DataFrame, words: DataFrame, counts: DataFrame, pair_score: float) -> DataFrame:
    """counts, with the pairs that belong together and without what they take from their words."""
    of = _merged(words)
    # a word may come from two tokens, with and without 's
    names = words.select("w", _stem().alias("stem")).distinct().join(of, "stem").select("w", "word", "count")
    for side in ("one", "two"):
        pairs = pairs.join(names.select(F.col("w").alias(side), F.col("word").alias(f"{side}_word"), F.col("count").alias(f"{side}_count")), side)
    pairs = pairs.groupBy("one_word", "two_word", "one_count", "two_count").agg(F.sum("n").alias("both"))
    total = counts.agg(F.sum("count").cast("double").alias("total"))       # one row
    c1, c2, c12, n = (F.col(c).cast("double") for c in ("one_count", "two_count", "both", "total"))
    rest = F.when(n > c1, (c2 - c12) / (n - c1)).otherwise(0.0)
    score = -2 * (_likelihood(c12, c1, c2 / n) + _likelihood(c2 - c12, n - c1, c2 / n) - _likelihood(c12, c1, c12 / c1) - _likelihood(c2 - c12, n - c1, rest))
    kept = pairs.join(F.broadcast(total), F.lit(True)).where(score > pair_score).select("one_word", "two_word", "both")
    kept = cut(kept)
    taken = kept.select(F.explode(F.array("one_word", "two_word")).alias("word"), (-F.col("both")).alias("count"))
    together = kept.select(F.concat_ws(" ", "one_word", "two_word").alias("word"), F.col("both").alias("count"))
    return counts.unionByName(taken).unionByName(together).groupBy("word").agg(F.sum("count").alias("count")).where(F.col("count") > 0)
