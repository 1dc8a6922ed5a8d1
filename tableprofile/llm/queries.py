"""The operators of this package as queries over whole sample tables, and SQL for those that have it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tableprofile.llm import chat_format, decontamination, hard_negatives, jaccard_join, language_id, lexical_search, licence_scan, line_dedup, mixing, quality_rules, sentence_pieces, suffix_dedup
from tableprofile.llm.common import table
from tableprofile.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {}
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def vocabulary(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    given = given.unionByName(spark.sql(f"""
        SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{hard}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{hard}'"""))
    done = chat_format.format_conversations(given)
    turns, loss = chat_format.parse(F.col("formatted")), chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    read = done.withColumn("turns", turns).withColumn("loss", loss)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licence_scan.scan(docs, licence_scan.fit(docs))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the declared language is the column lang, the host is the source."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs), declared=F.col("lang"), host=F.col("source"))


@query
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: markup, address suffix and host, with the text model of the documents."""
    html, host = F.col("html"), language_id.url_host(F.col("url"))
    return language_id.identify(
        table(spark, sf_dir, "pages"), language_id.fit(table(spark, sf_dir, "documents")), id="page_id", text=language_id.page_text(html),
        declared=language_id.page_language(html), host=host, suffix=language_id.host_suffix(host))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = quality_rules.ratio_table(docs, quality_rules.trusted_sample(table(spark, sf_dir, "labels")))
    return quality_rules.quality_rules(docs, ratios)


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"))


_CONTROL = ", ".join(f"'{c}'" for c in chat_format.CONTROL)
_PLAIN = "replace(replace(replace(replace({0}, '&#10;', chr(10)), '&#91;', '['), '&lt;', '<'), '&amp;', '&')"
_ESCAPED = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')"
ORACLES["op1_chat_format"] = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, contains(role, chr(10)) OR len([c FOR c IN [{_CONTROL}] IF contains(role || chr(10) || text, c)]) > 0
    OR {_PLAIN.format("role")} <> role OR {_PLAIN.format("text")} <> text AS conflict FROM given),
sized AS (
  SELECT *, {len(chat_format.OPEN) + len(chat_format.CLOSE) + 1} + CASE WHEN conflict
    THEN length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) ELSE length(role) + length(text) END AS chars FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

ORACLES["op10_mix_sources"] = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM by_source),
filled AS (
  SELECT a.source, ((SELECT sum(source_size) FROM ranked) - coalesce(sum(3 * b.source_size), 0))::DOUBLE
      / ((SELECT sum(weight) FROM ranked) - coalesce(sum(b.weight), 0)) AS level, any_value(a.weight) AS weight, any_value(a.source_size) AS s
  FROM ranked a LEFT JOIN ranked b ON 3 * b.source_size / b.weight < 3 * a.source_size / a.weight GROUP BY a.source),
level AS (SELECT max(level) AS level FROM filled WHERE level * weight <= 3 * s),
target AS (SELECT source, source_size, least(3 * source_size::DOUBLE, coalesce((SELECT level FROM level) * weight, 3 * source_size)) AS target FROM ranked),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sizes)
SELECT doc_id, size, source_size, target,
  (size * len([c FOR c IN [0, 1, 2] IF 2 * (c * source_size + start) + size < 2 * target]))::BIGINT AS taken
FROM placed JOIN target ON placed.source IS NOT DISTINCT FROM target.source"""


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op3_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS words, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
place AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d),
hit AS (
  SELECT p.r, p.i, win.n, win.item_id FROM (SELECT DISTINCT n FROM win) AS s, place AS p, win
  WHERE win.n = s.n AND p.i + s.n - 1 <= len(p.w) AND array_to_string(p.w[p.i:p.i + s.n - 1], ' ') = win.words),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup_strings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM pair JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(other) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id"""


@query
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = sentence_pieces.encode(table(spark, sf_dir, "documents"), model)
    digest = F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))
    return sentence_pieces.decode(ids.select(digest.alias("of"), "ids"), model, id="of").select("of.*", F.sha2("text", 256).alias("decoded_sha256"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
held AS (SELECT * FROM d WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM held),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM held) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * (SELECT N FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term),
item AS (
  SELECT item_id, term, count(*)::BIGINT AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
m AS (SELECT r, doc_id, 75 + ((25 * len(w)::BIGINT * (SELECT N FROM whole)) // (SELECT L FROM whole)) AS m FROM held),
scored AS (
  SELECT item_id, m.r, any_value(doc_id) AS doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN m ON m.r = tf.r GROUP BY item_id, m.r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(given.withColumn("label", label), F.col("id") % 50 == 0)


ORACLES["op12_hard_negatives"] = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows AS a JOIN rows AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
