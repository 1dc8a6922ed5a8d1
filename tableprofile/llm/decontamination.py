"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

1. Benchmark items are cut into windows; every window's terms are ordered by their frequency in the
   documents, and the rarest is the window's key term.
2. The index stores the postings (document, term, position) of the key terms.
3. A window is looked up in its key term's list only. The lists of its other terms are met there by
   offset: each posting is given the words that stand around it, and the term at offset d must be
   the word at position + d.

A document is a row: rows that repeat an id with another text are told apart by the text's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.llm.common import pick, small, written

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The ASCII characters between words, one by one. Splitting here takes a sixth of the time of matching runs of a negated class of ranges.
_BREAKS = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"


def words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, A-Z as a-z; null text has none."""
    plain = F.octet_length(text) == F.length(text)      # ASCII only: lower would change other letters as well
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, _BREAKS), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows with the items they come from: words, items. A shorter item, but not an empty
    one, is one window; items with a null id or without words have none."""
    items = pick(benchmark, item=id, text=text).where("item IS NOT NULL").select("item", words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    cut = items.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


def _bytes(column: str) -> Column:
    """About the size of an array of words."""
    return F.aggregate(column, F.lit(0), lambda n, w: n + F.octet_length(w) + 16)


def key_terms(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows with `key`, their rarest term in docs (text in `text`), and `at`, its first place."""
    terms = written(windows.select(F.explode("words").alias("term")).distinct())
    found = docs.select(F.explode(words(F.col("text"))).alias("term")).join(small(terms, F.octet_length("term")), "term")
    counts = terms.join(found.groupBy("term").agg(F.count("*").alias("n")), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))
    placed = windows.select("words", "items", F.posexplode("words").alias("at", "term")).join(counts, "term")
    first = F.min(F.struct("n", "term", "at")).alias("m")
    return placed.groupBy("words").agg(first, F.first("items").alias("items")).select(
        "words", "items", F.col("m.term").alias("key"), F.col("m.at").alias("at"))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given terms, gathered by document: id, version, postings (position from 1, term)."""
    all_words = docs.select("id", "version", F.posexplode(words(F.col("text"))).alias("position", "term"))
    hits = all_words.join(small(terms, F.octet_length("term")), "term")
    return hits.groupBy("id", "version").agg(
        F.sort_array(F.collect_set(F.struct((F.col("position") + 1).alias("position"), "term"))).alias("postings"))


def _documents(documents: DataFrame, id: str, text: str) -> DataFrame:
    docs = pick(documents, id=id, text=text)
    return docs.withColumn("version", F.xxhash64("text"))


def matches(documents: DataFrame, windows: DataFrame, id: str = "doc_id", text: str = "text", slop: int = 0) -> DataFrame:
    """Per document row: id, n_words, hits (start from 1, length, items of each match of a window).

    With slop 0 a match is the exact phrase. With slop s it is a proximity match: all words of the
    window, repeats counted, in any order, within a stretch of the window's length + s words that
    holds the key term; start and length are those of the stretch searched around the key term.
    """
    docs = _documents(documents, id, text)
    keyed = written(key_terms(docs, windows))
    postings = written(index(docs, keyed.select(F.col("key").alias("term")).distinct()))
    by_key = keyed.groupBy("key").agg(F.collect_list(F.struct("words", "items", "at")).alias("windows"))
    longest = keyed.agg(F.max(F.size("words"))).first()[0] or 0
    reach = longest - 1 + slop
    near = small(postings, 24 * F.size("postings") + 32)
    same = docs["id"].eqNullSafe(near["id"]) & docs["version"].eqNullSafe(near["version"])
    def around(w: Column) -> Column:
        return F.transform("postings", lambda p: F.struct(
            p["position"].alias("position"), p["term"].alias("term"), F.greatest(F.lit(1), p["position"] - reach).alias("first"),
            F.slice(w, F.greatest(F.lit(1), p["position"] - reach), F.least(p["position"], F.lit(reach + 1)) + reach).alias("near")))

    once = F.transform(F.array(words(F.col("text"))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), around(w).alias("around")))
    rows = docs.join(near, same, "left").select(docs["id"], docs["version"], F.inline(once))      # words: once a row
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    met = rows.select("row", F.explode("around").alias("p")).join(
        small(by_key, F.aggregate("windows", F.lit(0), lambda n, x: n + 40 + 24 * F.size(x["words"]) + 16 * F.size(x["items"]))), F.col("p.term") == F.col("key"))
    start = lambda x: F.col("p.position") - x["at"]
    if slop == 0:
        fits = F.filter("windows", lambda x: (start(x) >= 1) & (F.slice(F.col("p.near"), F.greatest(F.lit(1), start(x) - F.col("p.first") + 1), F.size(x["words"])) == x["words"]))
        found = F.transform(fits, lambda x: F.struct(start(x).alias("start"), F.size(x["words"]).alias("length"), x["items"].alias("items")))
    else:
        span = lambda x: F.size(x["words"]) + slop
        def stretch(x: Column, s: Column) -> Column:
            return F.slice(F.col("p.near"), F.greatest(F.lit(1), s - F.col("p.first") + 1), span(x))
        def holds(part: Column, wanted: Column) -> Column:
            return F.forall(wanted, lambda v: F.size(F.filter(part, lambda y: y == v)) >= F.size(F.filter(wanted, lambda y: y == v)))
        starts = lambda x: F.sequence(F.greatest(F.lit(1), F.col("p.position") - span(x) + 1), F.col("p.position"))
        found = F.flatten(F.transform("windows", lambda x: F.transform(
            F.slice(F.filter(starts(x), lambda s: holds(stretch(x, s), x["words"])), 1, 1),
            lambda s: F.struct(s.alias("start"), F.size(stretch(x, s)).alias("length"), x["items"].alias("items")))))
    hits = met.where(F.size(found) > 0).select("row", F.explode(found).alias("hit")).groupBy("row").agg(F.collect_set("hit").alias("hits"))
    return rows.select("row", "id", "n_words").join(hits, "row", "left").select(
        "id", "n_words", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per row of documents: id, n_words, n_hit (words inside a match), items (sorted as strings), spans.

    Null and empty texts have no words. Repeated rows each give a row. An empty benchmark hits nothing.
    Other columns are not read. Documents are scanned three times and never shuffled as a whole (only
    their few postings are), unless the postings outgrow a broadcast: then texts are shuffled once, by
    document. A frequent window costs one row per posting, whatever the number of windows on its key.
    """
    found = matches(documents, item_windows(benchmark, item_id, item_text, size), id, text)
    at = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))
    items = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("hits", lambda h: h["items"])), lambda i: i.cast("string"))))
    spans = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"], h["length"])))
    return found.select(F.col("id").alias(id), "n_words", F.size(F.array_distinct(at)).cast("long").alias("n_hit"),
                        items.alias("items"), spans.alias("spans"))
