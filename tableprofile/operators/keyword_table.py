"""Keyword extraction with a dictionary that is a table of any size.

A keyword can only match where each of its letter runs is a whole letter run of the text. Its head is its first run or, if it
has more, the first two and what stands between them. A bit set of fixed size, made from the hashes of all heads, goes to the
texts, and only places that hold a head leave them, with as many runs around them as the longest keyword has. Joined
with the shapes under that head (number of runs, characters before and after them), each place gives the few
strings that may be keywords; these are joined with the keywords as a whole. So neither a run that many keywords
share nor their number makes pairs that come to nothing, and no text is moved. No pattern is compiled per
keyword. What is measured small is broadcast, the rest is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.functions.columns import pick_fields, text_columns
from tableprofile.operators.dictionary import NO_BOUNDARY
from tableprofile.plans.cuts import cut, small_side
from tableprofile.plans.longform import filled_counts, to_long

BROADCAST_BYTES = 32 << 20
MOST_BARE = 1_000           # keywords without a letter, which are compared with every text
_WORDS = 1 << 14            # of 64 bits in the set of heads
_BEGIN, _END = "\x01", "\x02"


def _plain(text: Column) -> Column:
    return F.translate(F.lower(text), _BEGIN + _END, "  ")


def marked(text: Column) -> Column:
    """Lower-cased, with a mark at each place where a match may end and where one may begin: text edges,
    and beside every character that is no letter or number sign."""
    begins = F.regexp_replace(_plain(text), f"(?<![{NO_BOUNDARY}])", _BEGIN)
    return F.regexp_replace(begins, f"(?<!{_BEGIN})(?!{_BEGIN}?[{NO_BOUNDARY}])", _END)


def _runs(plain: Column) -> Column:
    return F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))


def _gaps(plain: Column) -> Column:
    """What stands before the first run, between the runs, and after the last: one more than there are runs."""
    return F.split(plain, r"\p{L}+")


def keyword_table(keywords: DataFrame, match_joined: bool = False, category: str = "category", keyword: str = "keyword") -> DataFrame:
    """(category, keyword, plain, head, runs, pre, post), written; a keyword without a letter has no head. Blank and null keywords
    are left out; of spellings that differ in case only the smallest stays. With match_joined, a spaced keyword is also
    searched without spaces."""
    # the pattern's class of white space is also that of the word lists read from text
    given = keywords.select(F.col(category).alias("category"), F.regexp_replace(F.col(keyword), r"(?U)^\s+|\s+$", "").alias("keyword")).where("keyword <> ''")
    one = given.groupBy("category", F.lower("keyword").alias("form")).agg(F.min("keyword").alias("keyword"))
    if match_joined:
        spaced = one.where(F.col("form").contains(" "))
        one = one.unionByName(spaced.withColumn("form", F.replace("form", F.lit(" "), F.lit(""))))
    parts = one.select("category", "keyword", _plain(F.col("form")).alias("plain")).withColumns(
        {"r": _runs(F.col("plain")), "g": _gaps(F.col("plain"))})
    head = F.when(F.size("r") > 1, F.concat(F.get("r", F.lit(0)), F.get("g", F.lit(1)), F.get("r", F.lit(1)))).otherwise(F.get("r", F.lit(0)))
    return cut(parts.select("category", "keyword", "plain", head.alias("head"), F.size("r").alias("runs"),
                            F.length(F.get("g", F.lit(0))).alias("pre"), F.length(F.element_at("g", -1)).alias("post")))


def _bit(head: Column) -> tuple[Column, Column]:
    h = F.xxhash64(head)
    return F.pmod(h, F.lit(_WORDS)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")


def _set_of(heads: DataFrame) -> Column:
    """The bit set as a constant of the plan: _WORDS numbers, whatever the number of heads."""
    word, bit = _bit(F.col("head"))
    held = heads.select(word.alias("word"), bit.alias("bit")).distinct().groupBy("word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).collect()       # at most _WORDS rows
    words = [0] * _WORDS
    for r in held:
        words[r.word] = r.bits
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>")


def _places(texts: DataFrame, heads: DataFrame, most_runs: int, most_chars: int) -> DataFrame:
    """(row_id, field, text, head, before, r, g): a row for each place that holds a head, with the runs from there on, the gaps
    behind each of them and the gap before."""
    keep = most_chars + 1
    # the marks at the edges are neither letters nor number signs; of a gap longer than any keyword the ends will do
    clipped = lambda g: F.when(F.length(g) > 2 * keep, F.concat(F.left(g, F.lit(keep)), F.right(g, F.lit(keep)))).otherwise(g)
    parts = texts.withColumn("plain", F.concat(F.lit(_BEGIN), _plain(F.col("value")), F.lit(_END))) \
        .select("row_id", "field", "text", _runs(F.col("plain")).alias("r"), F.transform(_gaps(F.col("plain")), clipped).alias("g"))
    every = F.flatten(F.transform("r", lambda x, i: F.array(
        F.struct(i.alias("i"), x.alias("head")), F.struct(i.alias("i"), F.concat(x, F.get("g", i + 1), F.get("r", i + 1)).alias("head")))))
    bits = _set_of(heads)

    def may_be(head: Column) -> Column:
        word, bit = _bit(head)
        return head.isNotNull() & (F.getbit(F.get(bits, word), bit) == 1)

    around = F.transform(F.filter(every, lambda p: may_be(p["head"])), lambda p: F.struct(
        p["head"].alias("head"), F.right(F.get("g", p["i"]), F.lit(keep)).alias("before"),
        F.slice("r", p["i"] + 1, F.lit(most_runs)).alias("r"), F.slice("g", p["i"] + 2, F.lit(most_runs)).alias("g")))
    return parts.select("row_id", "field", "text", F.inline(around))


def _candidates(places: DataFrame) -> DataFrame:
    """(row_id, field, text, plain): what stands at a place in the shape (runs, pre, post), if a match may begin and end there."""
    n, pre, post, before, after = F.col("runs"), F.col("pre"), F.col("post"), F.col("before"), F.get("g", F.col("runs") - 1)
    core = F.concat(F.array_join(F.transform(F.slice("r", F.lit(1), n - 1), lambda x, i: F.concat(x, F.get("g", i))), ""), F.get("r", n - 1))
    no_mark = lambda c: ~c.rlike(f"[{NO_BOUNDARY}]")
    fits = (F.size("r") >= n) & (F.length(before) > pre) & (F.length(after) > post) \
        & no_mark(F.substr(before, F.length(before) - pre, F.lit(1))) & no_mark(F.substr(after, post + 1, F.lit(1)))
    return places.where(fits).select("row_id", "field", "text", F.concat(F.right(before, pre), core, F.left(after, post)).alias("plain"))


def _found(long: DataFrame, table: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(row_id, field, text, category, keyword), some more than once; long holds (row_id, field, value), text is a hash of the value."""
    heads = cut(table.where(F.col("head").isNotNull()).select("head", "runs", "pre", "post").distinct())
    size = table.agg(F.sum(F.octet_length("plain") + F.octet_length("keyword") + F.octet_length("category") + 96).alias("bytes"),
                     F.count(F.when(F.col("head").isNull(), 1)).alias("bare"), F.max("runs").alias("runs"), F.max(F.length("plain")).alias("chars")).first()
    if size.bare > MOST_BARE:
        raise ValueError(f"{size.bare} keywords without a letter; each is compared with every text, so at most {MOST_BARE} may be given")
    shapes = heads.agg(F.sum(F.octet_length("head") + 96).alias("bytes")).first()
    texts = long.where(F.col("value").isNotNull()).withColumn("text", F.xxhash64("value"))
    names, kept = ["category", "keyword", "plain"], ["row_id", "field", "text", "category", "keyword"]
    near = lambda df, held: F.broadcast(df) if (held or 0) <= broadcast_bytes else df
    places = _places(texts, heads, max(1, size.runs or 0), size.chars or 0)
    candidates = _candidates(places.join(near(heads, shapes.bytes), "head"))
    if (size.bytes or 0) > broadcast_bytes:
        candidates = candidates.distinct()
    found = candidates.join(near(table.where(F.col("head").isNotNull()).select(*names), size.bytes), "plain").select(*kept)
    if size.bare:
        bare = F.broadcast(table.where(F.col("head").isNull()).select("category", "keyword", marked(F.col("plain")).alias("mark")))    # at most MOST_BARE
        found = found.unionByName(texts.withColumn("marked", marked(F.col("value"))).join(bare, F.contains(F.col("marked"), F.col("mark"))).select(*kept))
    return found


def _long(df: DataFrame, row_id: str, fields: list[str] | None) -> DataFrame:
    return to_long(df, text_columns(df) if fields is None else pick_fields(df, fields), row_id)


def extract_matches_of(df: DataFrame, keywords: DataFrame, row_id: str, fields: list[str] | None = None, match_joined: bool = False,
                       broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row_id, field, category, keyword), once each, for a table of (category, keyword)."""
    found = _found(_long(df, row_id, fields), keyword_table(keywords, match_joined), broadcast_bytes)
    return found.select("row_id", "field", "category", "keyword").distinct()


def extract_counts_of(df: DataFrame, keywords: DataFrame, row_id: str, fields: list[str] | None = None, match_joined: bool = False,
                      broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(field, category, keyword, matched_records, coverage_pct, evidence, records_processed): a row per keyword found.

    Evidence is the text of the smallest row_id; coverage is over all rows.
    """
    fields = text_columns(df) if fields is None else pick_fields(df, fields)
    long = _long(df, row_id, fields)
    # a text counts once, though it may hold a keyword under two forms; the texts themselves are fetched for the evidence only
    found = _found(long, keyword_table(keywords, match_joined), broadcast_bytes).distinct()
    first = F.min(F.when(F.col("row_id").isNotNull(), F.struct("row_id", "text")))
    counts = cut(found.groupBy("field", "category", "keyword").agg(F.count(F.lit(1)).alias("matched_records"), first.alias("first"))
                 .select("field", "category", "keyword", "matched_records", "first.row_id", "first.text"))
    place = ["field", "row_id", "text"]
    evidence = long.withColumn("text", F.xxhash64("value")).join(small_side(counts.select(*place).distinct()), place, "left_semi") \
        .dropDuplicates(place).withColumnRenamed("value", "evidence")
    counts = counts.join(evidence, place, "left")
    return counts.join(F.broadcast(filled_counts(df, fields)), "field").select(      # one row per field
        "field", "category", "keyword", "matched_records", (F.col("matched_records") / F.col("total") * 100.0).alias("coverage_pct"),
        "evidence", F.col("filled").alias("records_processed"))
