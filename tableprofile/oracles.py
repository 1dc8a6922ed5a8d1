"""SQL statements that state what each query of the workload must return."""

from __future__ import annotations

from tableprofile.functions.shapes import EMAIL, IPV4, MAC
from tableprofile.operators.dictionary import Dictionary, Entry, built_in
from tableprofile.operators.words import PAIR_SCORE, STOP_WORDS
from tableprofile.sources.readers import NA_TOKENS
from tableprofile.workload import CUSTOMER, FIVE, LICENCES, NEARLY_CONSTANT, PARTS, PLACES, SPELLINGS, TEXT_TERMS

ORACLES: dict[str, str] = {}

_LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_ORDERS_TEXT = "(SELECT *, strftime(o_orderdate, '%m/%d/%Y') AS order_day FROM orders)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _each(fields, one) -> str:
    return "\nUNION ALL\n".join(one(f) for f in fields)


# --- summaries and keys -------------------------------------------------------------------

ORDERS = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "float",
          "o_orderdate": "datetime", "o_orderpriority": "string"}
LINEITEM = {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int",
            "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
            "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime"}
LABELLED = {"doc_id": "int", "text": "string", "lang": "string", "source": "string", "n_chars": "int",
            "quality": "int", "toxic": "int"}


def _summary(table: str, fields: dict[str, str]) -> str:
    return _each(fields, lambda f: f"""
        SELECT '{f}' AS field, '{fields[f]}' AS type,
               CAST(count({f}) AS DOUBLE) / count(*) * 100.0 AS coverage_pct,
               count(*) - count({f}) AS nulls, count(DISTINCT {f}) AS distinct_values FROM {table}""")


ORACLES["field_summary"] = _summary("orders", ORDERS)
ORACLES["field_summary_lineitem"] = _summary("lineitem", LINEITEM)
ORACLES["field_summary_nulls"] = _summary(_LABELLED, LABELLED)
ORACLES["coverage"] = _each(LABELLED, lambda f: f"""
    SELECT '{f}' AS field, CAST(count({f}) AS DOUBLE) / count(*) * 100.0 AS coverage_pct FROM {_LABELLED}""")
ORACLES["dataset_stats"] = "SELECT count(*) AS total_rows, 11 AS total_columns FROM lineitem"
ORACLES["detect_keys"] = "SELECT field FROM (" + _each(ORDERS, lambda f: f"""
    SELECT '{f}' AS field, count(*) = count({f}) AND count(*) = count(DISTINCT {f}) AS ok FROM orders""") + ") WHERE ok"


def _composite(table: str, keys: list[str], verdict: bool) -> str:
    whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""
        SELECT {_q(', '.join(keys))} AS keys, (SELECT count(*) FROM {table}) AS total_rows, count(*) AS unique_keys
               {', count(*) = (SELECT count(*) FROM ' + table + ') AS is_key' if verdict else ''}
        FROM (SELECT DISTINCT {', '.join(keys)} FROM {table} WHERE {whole})"""


ORACLES["check_composite_key_valid"] = _composite("conversations", ["conv_id", "turn"], True)
ORACLES["check_composite_key_invalid"] = _composite("lineitem", ["l_orderkey", "l_linenumber"], True)
ORACLES["unique_key_count"] = _composite(_LABELLED, ["doc_id", "quality"], False)
ORACLES["drop_nulls"] = f"""SELECT doc_id, quality, toxic FROM {_LABELLED}
    WHERE quality IS NOT NULL AND toxic IS NOT NULL"""

# --- values -------------------------------------------------------------------------------


def _long(table: str, fields) -> str:
    return _each(fields, lambda f: f"SELECT '{f}' AS field, coalesce(CAST({f} AS VARCHAR), 'NULL') AS value FROM {table}")


def _top(long: str, total: str = "Total") -> str:
    return f"""
        WITH c AS (SELECT field, value, count(*) AS n FROM ({long}) GROUP BY ALL),
             t AS (SELECT field, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY field),
             r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
        SELECT r.field, r.value, r.n AS count, CAST(r.n AS DOUBLE) / t.total * 100.0 AS percentage
        FROM r JOIN t ON r.field = t.field WHERE rank <= 10
        UNION ALL SELECT field, '{total}', total, 100.0 FROM t"""


ORACLES["top_values"] = _top(_long("orders", ORDERS))
ORACLES["top_values_nulls"] = _top(_long(_LABELLED, ["lang", "source", "quality", "toxic"]))
ORACLES["top_values_documents"] = _top(_long("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
ORACLES["unique_values"] = "SELECT c_name AS value, count(*) AS count FROM customer GROUP BY c_name"
ORACLES["top_values_per_key"] = _top(_long(
    "(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)",
    ["o_orderstatus", "o_orderpriority"]))
ORACLES["chart_rows"] = f"""
    WITH c AS (SELECT field, value, count(*) AS n FROM ({_long(_LABELLED, ["lang", "source", "text", "quality"])}) GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c),
         s AS (SELECT field, n, CASE WHEN length(value) <= 50 THEN value ELSE substring(value, 1, 47) || '...' END AS value,
                      round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY field) * 100.0, 1) AS percentage
               FROM r WHERE rank <= 10)
    SELECT field, value, n AS count, percentage, value || ' (' || n || ', ' || percentage || '%)' AS label FROM s"""

# --- kinds and dates ----------------------------------------------------------------------

_HINT = "[-/]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def _date_text(f: str) -> str:
    return f"coalesce(try_cast({f} AS TIMESTAMP), try_strptime({f}, '%m/%d/%Y'))"


def _date_share(table: str, f: str) -> str:
    return f"coalesce(count(*) FILTER ({_date_text(f)} IS NOT NULL) / nullif(CAST(count({f}) AS DOUBLE), 0), 0.0)"


def _hint(table: str, f: str, key: str) -> str:
    return f"""(SELECT coalesce(bool_or(regexp_matches(lower(v), '{_HINT}')), false) FROM
               (SELECT {f} AS v FROM {table} WHERE {f} IS NOT NULL ORDER BY {key} LIMIT 10))"""


def _kinds(table: str, fields: dict[str, str], key: str) -> str:
    def one(f: str) -> str:
        label = fields[f]
        if label in ("int", "float"):
            rest = "'numeric'"
        elif label == "datetime":
            rest = "'datetime'"
        else:
            rest = f"""CASE WHEN {_date_share(table, f)} >= 0.9 AND {_hint(table, f, key)} THEN 'datetime'
                       WHEN avg(length({f})) > 50 AND bool_or(regexp_matches({f}, '\\p{{L}}')) THEN 'long_text'
                       WHEN least(10, count(DISTINCT {f}) + CAST(count({f}) < count(*) AS INT)) < 5 THEN 'donut'
                       ELSE 'bar' END"""
        return f"""SELECT '{f}' AS field, CASE WHEN count(DISTINCT {f}) = count(*) THEN 'unique' ELSE {rest} END AS kind
                   FROM {table}"""
    return _each(fields, one)


ORACLES["field_kinds"] = _kinds(_ORDERS_TEXT, {**ORDERS, "order_day": "string"}, "o_orderkey")
ORACLES["field_kinds_documents"] = _kinds(_LABELLED, LABELLED, "doc_id")
ORACLES["detect_dates"] = _each(["o_orderstatus", "o_orderpriority", "order_day"], lambda f: f"""
    SELECT '{f}' AS field, {_date_share(_ORDERS_TEXT, f)} AS date_share,
           {_date_share(_ORDERS_TEXT, f)} >= 0.9 AND {_hint(_ORDERS_TEXT, f, 'o_orderkey')} AS is_date
    FROM {_ORDERS_TEXT}""") + "\nUNION ALL SELECT 'o_orderdate', 1.0, true"


def _trend(table: str, field: str, period: str) -> str:
    step = {"quarter": "3 MONTH", "week": "7 DAY"}.get(period, f"1 {period.upper()}")
    start = f"CAST(date_trunc('{period}', {field}) AS DATE)"
    label = "p" if period == "day" else f"CAST(p + INTERVAL {step} - INTERVAL 1 DAY AS DATE)"
    return f"""
        WITH c AS (SELECT {start} AS p, count(*) AS n FROM {table} WHERE {field} IS NOT NULL GROUP BY ALL),
             s AS (SELECT CAST(unnest(generate_series((SELECT min(p) FROM c), (SELECT max(p) FROM c), INTERVAL {step})) AS DATE) AS p)
        SELECT CAST({label} AS VARCHAR) AS period, coalesce(c.n, 0) AS count FROM s LEFT JOIN c USING (p)"""


for _period in ("day", "week", "month", "quarter", "year"):
    ORACLES[f"trend_{_period}"] = _trend("orders", "o_orderdate", _period)
ORACLES["trend_events"] = _trend("events", "ts", "day")
ORACLES["trend_text_dates"] = _trend("orders", "o_orderdate", "month")
ORACLES["date_listing"] = "SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date FROM orders"

ORACLES["mixed_dates"] = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, true AS written, false AS other FROM orders"

# --- words and distributions --------------------------------------------------------------

def _likelihood(hits: str, tries: str, chance: str) -> str:
    return f"ln(greatest({chance}, 1e-10)) * ({hits}) + ln(greatest(1 - {chance}, 1e-10)) * (({tries}) - ({hits}))"


_REST = "(CASE WHEN n > c1 THEN (c2 - c12) / (n - c1) ELSE 0.0 END)"
ORACLES["word_pairs"] = f"""
    WITH r AS (SELECT [regexp_replace(t, '''s$', '') FOR t IN regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']+')] AS ws FROM documents),
         row AS (SELECT [w FOR w IN ws IF w <> '' AND NOT regexp_matches(w, '^\\p{{Nd}}+$')] AS ws FROM r),
         k AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM row) WHERE w NOT IN ({', '.join(_q(s) for s in STOP_WORDS)}) GROUP BY w),
         m AS (SELECT w, CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 1 AND substring(w, 1, length(w) - 1) IN (SELECT w FROM k)
                              THEN substring(w, 1, length(w) - 1) ELSE w END AS word, n FROM k),
         one AS (SELECT word, sum(n)::BIGINT AS n FROM m GROUP BY word),
         total AS (SELECT sum(n)::DOUBLE AS n FROM one),
         p AS (SELECT ws[i] AS a, ws[i + 1] AS b FROM (SELECT ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM row)),
         pair AS (SELECT x.word AS a, y.word AS b, count(*)::DOUBLE AS c12 FROM p JOIN m x ON p.a = x.w JOIN m y ON p.b = y.w GROUP BY ALL),
         c AS (SELECT pair.a, pair.b, c12, u.n::DOUBLE AS c1, v.n::DOUBLE AS c2, total.n AS n FROM pair JOIN one u ON pair.a = u.word JOIN one v ON pair.b = v.word, total),
         kept AS (SELECT a, b, c12 FROM c WHERE -2 * ({_likelihood("c12", "c1", "c2 / n")} + {_likelihood("c2 - c12", "n - c1", "c2 / n")}
                  - ({_likelihood("c12", "c1", "c12 / c1")}) - ({_likelihood("c2 - c12", "n - c1", _REST)})) > {PAIR_SCORE}),
         entry AS (SELECT word, n FROM one UNION ALL SELECT unnest([a, b]), -c12 FROM kept UNION ALL SELECT a || ' ' || b, c12 FROM kept)
    SELECT word, sum(n)::BIGINT AS count FROM entry GROUP BY word HAVING sum(n) > 0"""

ORACLES["word_counts"] = f"""
    WITH tok AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']+')) AS t FROM documents),
         w AS (SELECT regexp_replace(t, '''s$', '') AS w, count(*) AS n FROM tok GROUP BY ALL),
         k AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM w
               WHERE w <> '' AND NOT regexp_matches(w, '^\\p{{Nd}}+$') AND w NOT IN ({', '.join(_q(s) for s in STOP_WORDS)})
               GROUP BY w),
         m AS (SELECT CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 1
                                AND substring(w, 1, length(w) - 1) IN (SELECT w FROM k)
                           THEN substring(w, 1, length(w) - 1) ELSE w END AS word, n FROM k)
    SELECT word, CAST(sum(n) AS BIGINT) AS count FROM m GROUP BY word ORDER BY count DESC, word LIMIT 200"""

_NICE = """
    b AS (SELECT min({x}) AS lo, max({x}) AS hi FROM {t}),
    steps AS (SELECT CASE WHEN e >= 0 THEN lead * power(10.0, e) ELSE lead / power(10.0, -e) END AS step
              FROM (SELECT unnest([1.0, 2.0, 5.0]) AS lead), range(-12, 13) r(e)),
    s AS (SELECT min(step) AS step FROM steps, b WHERE floor(hi / step) - floor(lo / step) + 1 <= {bins})"""


def _histogram(table: str, x: str, bins: int) -> str:
    return f"""
        WITH {_NICE.format(t=table, x=x, bins=bins)}
        SELECT CAST(floor({x} / step) * step AS DOUBLE) AS bin_start,
               CAST((floor({x} / step) + 1) * step AS DOUBLE) AS bin_end, count(*) AS count
        FROM {table}, s GROUP BY ALL"""


ORACLES["histogram_30"] = _histogram("lineitem", "l_extendedprice", 30)
ORACLES["histogram_50"] = _histogram("lineitem", "l_quantity", 50)
ORACLES["outlier_histogram"] = f"""
    WITH {_NICE.format(t="events", x="value", bins=50)},
         z AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
    SELECT CAST(floor(value / step) * step AS DOUBLE) AS bin_start,
           CAST((floor(value / step) + 1) * step AS DOUBLE) AS bin_end, count(*) AS count,
           count(*) FILTER (abs((value - m) / sd) > 3) AS zscore_outliers
    FROM events, s, z GROUP BY ALL"""
_NUMBERS = [f for f, label in LINEITEM.items() if label in ("int", "float")]
ORACLES["histograms"] = _each(_NUMBERS, lambda f: f"SELECT '{f}' AS field, * FROM ({_histogram('lineitem', f, 30)})")
ORACLES["outlier_histograms"] = _each(["user_id", "value"], lambda f: f"SELECT '{f}' AS field, * FROM (" + ORACLES["outlier_histogram"].replace("value", f) + ")")
_SHOWN = {"unique": ["unique_values"], "numeric": ["histogram", "top_values"], "datetime": ["trend_day"], "donut": ["top_values", "chart"],
          "bar": ["top_values", "chart"], "long_text": ["top_values"]}
_ROWS = {"unique_values": "count(*)", "top_values": "least(10, count(DISTINCT {f}) + CAST(count({f}) < count(*) AS INT)) + 1",
         "chart": "least(10, count(DISTINCT {f}) + CAST(count({f}) < count(*) AS INT))"}


def _insight_rows(f: str, label: str) -> str:
    """(field, name, rows) of each table that a field of this type can have."""
    parts = [f"SELECT '{f}' AS field, '{name}' AS name, {rows.format(f=f)} AS rows FROM {_ORDERS_TEXT}" for name, rows in _ROWS.items()]
    if label in ("int", "float"):
        parts.append(f"SELECT '{f}', 'histogram', count(*) FROM ({_histogram('orders', f, 30)})")
    if label in ("datetime", "string"):
        day = f if label == "datetime" else f"try_strptime({f}, '%m/%d/%Y')"
        parts.append(f"SELECT '{f}', 'trend_day', date_diff('day', min({day}), max({day})) + 1 FROM {_ORDERS_TEXT}")
    return "\nUNION ALL\n".join(parts)


ORACLES["insights"] = f"""
    WITH kind AS ({ORACLES["field_kinds"]}),
         size AS ({_each({**ORDERS, "order_day": "string"}.items(), lambda p: _insight_rows(*p))}),
         shown AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{n}')" for k, ns in _SHOWN.items() for n in ns)}) s(kind, name))
    SELECT kind.field, kind.kind, name, CAST(rows AS BIGINT) AS rows FROM kind JOIN shown USING (kind) JOIN size USING (field, name)"""
ORACLES["box_stats"] = """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                      quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
           min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
           max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
           count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS points_outside
    FROM events, q"""

# --- filters ------------------------------------------------------------------------------

ORACLES["project"] = "SELECT p_partkey, p_brand FROM part"
ORACLES["filter_equals"] = "SELECT * FROM part WHERE p_brand IN ('Brand#2', 'Brand#4')"
ORACLES["filter_contains"] = "SELECT * FROM part WHERE contains(lower(p_name), 'ring')"
ORACLES["filter_starts_with"] = "SELECT * FROM part WHERE starts_with(lower(p_type), 'eco')"
ORACLES["filter_regex"] = r"SELECT * FROM part WHERE regexp_matches(lower(p_brand), '^(?:brand#\D*1\d)')"
ORACLES["filter_range"] = "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20"
ORACLES["filter_less_than"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 50000.0"
ORACLES["filter_greater_than"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000.0"
ORACLES["filter_and"] = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
    WHERE l_returnflag IN ('R') AND l_quantity BETWEEN 5 AND 15 AND l_extendedprice > 60000.0"""
ORACLES["filter_choices"] = "SELECT DISTINCT p_type AS value FROM part WHERE lower(p_type) NOT IN ('nan', 'none', '')"
ORACLES["filter_bounds"] = _each(["l_quantity", "l_extendedprice", "l_linenumber"], lambda f: f"""
    SELECT '{f}' AS field, CAST(min({f}) AS DOUBLE) AS min_value, CAST(max({f}) AS DOUBLE) AS max_value,
           round(avg({f}), 4) AS mean FROM lineitem""")

# --- patterns -----------------------------------------------------------------------------

# The engine has no look-around, so the name of a host is told by two further tests.
_KNOWN = rf"""
    CASE WHEN regexp_matches(v, '{IPV4}') THEN
              CASE WHEN regexp_matches(v, '^0*10\.') OR regexp_matches(v, '^127\.') OR regexp_matches(v, '^192\.168\.')
                     OR regexp_matches(v, '^169\.254\.') OR regexp_matches(v, '^172\.0?(1[6-9]|2[0-9]|3[01])\.')
                   THEN 'Internal IP' ELSE 'External IP' END
         WHEN regexp_matches(v, '{MAC}') THEN 'MAC Address'
         WHEN regexp_matches(v, '{EMAIL}') THEN 'Email'
         WHEN regexp_matches(v, '^[A-Za-z0-9-]{{1,63}}(\.[A-Za-z]{{2,}})+$') AND NOT starts_with(v, '-')
              AND NOT contains(v, '-.') THEN 'FQDN'
         ELSE NULL END"""
_SHAPE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v,
    '\p{Nd}', '9', 'g'), '[^\p{L}\p{N}\p{M}_\s]', '@', 'g'), '\p{Lu}', 'A', 'g'), '\p{Ll}', 'a', 'g'), '[^Aa9@]', '?', 'g')"""


def _patterns(table: str, fields, key: str) -> str:
    long = _each(fields, lambda f: f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, {key} AS id FROM {table}")
    return f"""
        WITH l AS (SELECT *, trim(value) AS v FROM ({long}) WHERE value IS NOT NULL),
             p AS (SELECT field, value, id, coalesce({_KNOWN}, {_SHAPE}) AS pattern FROM l),
             g AS (SELECT field, pattern, arg_min(value, id) AS example, count(*) AS n FROM p GROUP BY field, pattern)
        SELECT field, pattern, example, n AS count,
               CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY field) AS BIGINT) * 100.0 AS confidence_pct FROM g"""


_CUSTOMER_FIELDS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORACLES["pattern_report"] = _patterns("customer", _CUSTOMER_FIELDS, "c_custkey")
ORACLES["pattern_report_orders"] = _patterns("orders", ORDERS, "o_orderkey")
ORACLES["top_pattern"] = f"""SELECT * FROM ({_patterns("customer", _CUSTOMER_FIELDS, "c_custkey")})
    QUALIFY row_number() OVER (PARTITION BY field ORDER BY count DESC, pattern) = 1"""


def _formats(values: str) -> str:
    return f"""SELECT pattern, count(*) AS count FROM (SELECT {_KNOWN} AS pattern FROM ({values}))
               WHERE pattern IS NOT NULL GROUP BY pattern"""


ORACLES["known_formats"] = _formats(r"SELECT unnest(regexp_split_to_array(text, '[\s,;()]+')) AS v FROM documents")
ORACLES["known_formats_hosts"] = _formats("SELECT regexp_extract(url, '://([^/]+)', 1) AS v FROM pages")

# --- single-column outliers ---------------------------------------------------------------


def _outlier_summary(table: str, fields, places: int | None = 4) -> str:
    def r(x: str) -> str:
        return x if places is None else f"round({x}, {places})"
    return _each(fields, lambda f: f"""
        SELECT '{f}' AS "column", count(*) AS total_values,
               count(*) FILTER (abs(({f} - m) / sd) > 3) AS zscore_outliers,
               count(*) FILTER ({f} < q1 - 1.5 * (q3 - q1) OR {f} > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
               CAST(count(*) FILTER (abs(({f} - m) / sd) > 3) AS DOUBLE) / count(*) * 100.0 AS zscore_outlier_pct,
               CAST(count(*) FILTER ({f} < q1 - 1.5 * (q3 - q1) OR {f} > q3 + 1.5 * (q3 - q1)) AS DOUBLE)
                   / count(*) * 100.0 AS iqr_outlier_pct,
               CAST(min({f}) AS DOUBLE) AS min_value, CAST(max({f}) AS DOUBLE) AS max_value,
               {r('any_value(m)')} AS mean, {r('any_value(sd)')} AS std_dev,
               any_value(q1) AS q1, any_value(q3) AS q3, {r('any_value(q3 - q1)')} AS iqr
        FROM {table}, (SELECT avg({f}) AS m, stddev_samp({f}) AS sd, CAST(quantile_cont({f}, 0.25) AS DOUBLE) AS q1,
                              CAST(quantile_cont({f}, 0.75) AS DOUBLE) AS q3 FROM {table}) s""")


_EVENT_FIELDS = ["event_id", "user_id", "value"]
_NUMERIC = [f for f, t in LINEITEM.items() if t in ("int", "float")]
_PARTLY = "(SELECT doc_id, n_chars, quality, toxic, 7 AS same FROM documents LEFT JOIN labels USING (doc_id))"
ORACLES["outlier_eligible"] = _each(["doc_id", "n_chars", "quality", "toxic", "same"], lambda f: f"""
    SELECT * FROM ({_outlier_summary(_PARTLY, [f])}) WHERE (SELECT min({f}) < max({f}) AND 2 * count({f}) >= count(*) FROM {_PARTLY})""")
ORACLES["outlier_summary"] = _outlier_summary("lineitem", _NUMERIC)
ORACLES["outlier_summary_events"] = _outlier_summary("events", _EVENT_FIELDS)
_STATS = """(SELECT avg(value) AS m, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1,
                    quantile_cont(value, 0.75) AS q3 FROM events) s"""
_Z = "abs((value - m) / sd) > 3"
_IQR = "(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"
ORACLES["outlier_rows_zscore"] = f"SELECT event_id, value FROM events, {_STATS} WHERE {_Z}"
ORACLES["outlier_rows_iqr"] = f"SELECT event_id, value FROM events, {_STATS} WHERE {_IQR}"
ORACLES["outlier_export"] = f"""SELECT event_id, value, 'Z-score' AS method FROM events, {_STATS} WHERE {_Z}
    UNION ALL SELECT event_id, value, 'IQR' FROM events, {_STATS} WHERE {_IQR}"""
ORACLES["outlier_overview"] = f"""
    SELECT *, abs(zscore_pct - iqr_pct) > 5 AS methods_differ FROM (
        SELECT CAST(sum(zscore_outliers) AS BIGINT) AS zscore_outliers, CAST(sum(iqr_outliers) AS BIGINT) AS iqr_outliers,
               CAST(sum(total_values) AS BIGINT) AS total_values,
               CAST(sum(zscore_outliers) AS DOUBLE) / CAST(sum(total_values) AS BIGINT) * 100.0 AS zscore_pct,
               CAST(sum(iqr_outliers) AS DOUBLE) / CAST(sum(total_values) AS BIGINT) * 100.0 AS iqr_pct
        FROM ({_outlier_summary("events", _EVENT_FIELDS)}))"""
ORACLES["outlier_flags"] = f"""
    SELECT "column", std_dev > mean AS high_variability, iqr > mean AS wide_spread
    FROM ({_outlier_summary("events", _EVENT_FIELDS, None)}) WHERE zscore_outliers > 0 OR iqr_outliers > 0"""

_FLAGGED = f"""flagged AS (
    SELECT event_id AS row_id, 'Z-score' AS method FROM ({ORACLES["outlier_rows_zscore"]})
    UNION ALL SELECT event_id, 'IQR' FROM ({ORACLES["outlier_rows_iqr"]}))"""
_FOUND = f"""WITH {_FLAGGED}, found AS (
    SELECT m.method, pos, count(f.row_id) AS outliers_found, count(f.row_id) / (SELECT count(*) FROM events) * 100.0 AS outlier_pct
    FROM (VALUES ('Z-score', 0), ('IQR', 1)) AS m(method, pos) LEFT JOIN flagged f ON f.method = m.method GROUP BY m.method, pos)"""
ORACLES["method_summary_value"] = f"{_FOUND} SELECT method, outliers_found, outlier_pct FROM found"
ORACLES["consensus_value"] = f"""
    WITH {_FLAGGED} SELECT row_id FROM flagged GROUP BY row_id HAVING count(DISTINCT method) = 2"""
ORACLES["method_ranking_value"] = f"""{_FOUND}
    SELECT CAST(sum(outliers_found) AS BIGINT) AS total_flags, sum(outliers_found) / (SELECT count(*) FROM events) * 100.0 AS total_pct,
           first(method ORDER BY outliers_found DESC, pos) AS most, first(method ORDER BY outliers_found, pos) AS fewest,
           sum(outliers_found) / (SELECT count(*) FROM events) > 0.1 AS high FROM found"""
ORACLES["labelled_points_value"] = f"""
    WITH {_FLAGGED} SELECT event_id AS row_id, m.method, f.row_id IS NOT NULL AS is_outlier, CAST(user_id AS DOUBLE) AS user_id, value
    FROM events, (VALUES ('Z-score'), ('IQR')) AS m(method) LEFT JOIN flagged f ON f.row_id = event_id AND f.method = m.method"""
ORACLES["all_outliers_value"] = f"""
    WITH {_FLAGGED} SELECT row_id, method, CAST(user_id AS DOUBLE) AS user_id, value FROM flagged JOIN events ON event_id = row_id"""
ORACLES["iforest_far"] = "SELECT count(*) + 5 AS rows, true AS share_holds, true AS far_found FROM customer"
ORACLES["kmeans_share"] = "SELECT count(*) AS rows, true AS share_holds FROM customer"
ORACLES["best_k_range"] = "SELECT CAST(9 AS BIGINT) AS tried, true AS one_best, true AS best_is_highest"
ORACLES["field_summary_estimate"] = "SELECT column_name AS field, true AS close FROM (DESCRIBE SELECT * FROM lineitem)"

# --- multi-column outliers ----------------------------------------------------------------


def _scaled(table: str, key: str, cols) -> str:
    return f"SELECT {key} AS row_id, " + ", ".join(
        f"({c} - (SELECT avg({c}) FROM {table})) / (SELECT stddev_pop({c}) FROM {table}) AS x{i}"
        for i, c in enumerate(cols)) + f" FROM {table}"


ORACLES["standardise"] = "SELECT row_id, " + ", ".join(
    f"round(x{i}, 6) AS {c}" for i, c in enumerate(CUSTOMER[1:])) + f" FROM ({_scaled('customer', 'c_custkey', CUSTOMER[1:])})"


#: Clusters that are known, so their centres and what lies far from them are plain averages.
_PLANTED = """
    WITH t AS (SELECT c_custkey, c_nationkey % 3 AS g, c_nationkey % 3 * 40 + c_acctbal / 1000 AS x,
                 CASE WHEN c_nationkey % 3 = 1 THEN 50.0::DOUBLE ELSE 0 END + (c_custkey % 97) / 10.0::DOUBLE AS y FROM customer),
         s AS (SELECT c_custkey AS row_id, g, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM t),
         centre AS (SELECT g, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(x * x + y * y) AS length FROM s GROUP BY g)"""
ORACLES["kmeans_planted"] = f"""{_PLANTED},
    far AS (SELECT row_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM s JOIN centre USING (g))
    SELECT row_id FROM far WHERE d > (SELECT quantile_cont(d, 0.9) FROM far)"""
ORACLES["best_k_planted"] = f"""{_PLANTED},
    apart AS (SELECT row_id, s.g AS own, c.g, c.n, x * x + y * y + length - 2 * (x * cx + y * cy) AS d FROM s, centre c),
    two AS (SELECT row_id, max(d * n / (n - 1)) FILTER (g = own) AS a, min(d) FILTER (g <> own) AS b FROM apart GROUP BY row_id)
    SELECT 3 AS k, round(avg((b - a) / greatest(a, b)), 6) AS silhouette, true AS best FROM two"""


def _distance(n: int, a: str, b: str) -> str:
    return " + ".join(f"({a}.x{i} - {b}.x{i}) * ({a}.x{i} - {b}.x{i})" for i in range(n))


def _noise(table: str, key: str, cols, eps: float) -> str:
    return f"""
        WITH p AS MATERIALIZED ({_scaled(table, key, cols)}),
             core AS MATERIALIZED (SELECT a.row_id FROM p a, p b WHERE {_distance(len(cols), 'a', 'b')} <= {eps * eps}
                      GROUP BY a.row_id HAVING count(*) >= 5),
             c AS MATERIALIZED (SELECT p.* FROM p SEMI JOIN core ON p.row_id = core.row_id),
             saved AS (SELECT DISTINCT a.row_id FROM p a, c WHERE {_distance(len(cols), 'a', 'c')} <= {eps * eps})
        SELECT row_id FROM p WHERE row_id NOT IN (SELECT row_id FROM saved)"""


def _noise_rows(columns: dict[str, str], eps: float) -> str:
    """As _noise, of lineitem numbered here; pairs meet by the cells of the first two columns."""
    n, names = len(columns), list(columns)
    cells = "floor(x0 / {0})::INT AS c0, floor(x1 / {0})::INT AS c1".format(eps * (1 + 1e-9))
    near = f"(SELECT unnest([-1, 0, 1]) AS d0) u, (SELECT unnest([-1, 0, 1]) AS d1) v"
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x{i}" for i, c in enumerate(names))
    return f"""
        WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, l_orderkey, l_linenumber, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM lineitem),
             s AS MATERIALIZED (SELECT r, {scaled} FROM t),
             p AS MATERIALIZED (SELECT *, {cells} FROM s),
             q AS MATERIALIZED (SELECT p.* REPLACE (c0 + d0 AS c0, c1 + d1 AS c1) FROM p, {near}),
             core AS MATERIALIZED (SELECT q.r FROM q JOIN p ON q.c0 = p.c0 AND q.c1 = p.c1 AND {_distance(n, 'q', 'p')} <= {eps * eps}
                      GROUP BY q.r HAVING count(*) >= 5),
             c AS MATERIALIZED (SELECT p.* FROM p SEMI JOIN core ON p.r = core.r),
             rest AS MATERIALIZED (SELECT q.* FROM q ANTI JOIN core ON q.r = core.r),
             saved AS (SELECT DISTINCT rest.r FROM rest JOIN c ON rest.c0 = c.c0 AND rest.c1 = c.c1 AND {_distance(n, 'rest', 'c')} <= {eps * eps})
        SELECT l_orderkey, l_linenumber, {', '.join(names)} FROM t
        WHERE r NOT IN (SELECT r FROM core) AND r NOT IN (SELECT r FROM saved)"""


ORACLES["dbscan_noise_five"] = _noise_rows({c: c for c in FIVE}, 0.35)
ORACLES["dbscan_noise_seven"] = _noise_rows(NEARLY_CONSTANT, 0.25)
ORACLES["dbscan_noise"] = _noise("customer", "c_custkey", CUSTOMER, 0.2)
ORACLES["dbscan_noise_default"] = _noise("events", "event_id", ["user_id", "value"], 0.5)


def _lof(table: str, key: str, cols, k: int = 20) -> str:
    points = f"SELECT {key} AS row_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(cols)) + f" FROM {table}"
    return f"""
        p AS MATERIALIZED ({points}),
        nb AS MATERIALIZED (SELECT a.row_id AS id, b.row_id AS other, sqrt({_distance(len(cols), 'a', 'b')}) AS d
               FROM p a, p b WHERE a.row_id <> b.row_id
               QUALIFY row_number() OVER (PARTITION BY a.row_id ORDER BY d, b.row_id)
                       <= least({k}, (SELECT count(*) - 1 FROM p))),
        reach AS (SELECT id AS other, max(d) AS kd FROM nb GROUP BY id),
        lrd AS MATERIALIZED (SELECT id, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nb JOIN reach USING (other) GROUP BY id),
        lof AS MATERIALIZED (SELECT nb.id AS row_id, avg(o.lrd) / any_value(s.lrd) AS lof
                FROM nb JOIN lrd o ON nb.other = o.id JOIN lrd s ON nb.id = s.id GROUP BY nb.id)"""


ORACLES["lof_outliers"] = f"""WITH {_lof("customer", "c_custkey", CUSTOMER)}
    SELECT row_id FROM lof WHERE -lof < (SELECT quantile_cont(-lof, 0.1) FROM lof)"""
ORACLES["lof_scores"] = f"""WITH {_lof("supplier", "s_suppkey", ["s_nationkey", "s_acctbal"])}
    SELECT row_id, round(lof, 4) AS lof FROM lof"""

# --- extraction ---------------------------------------------------------------------------

_EDGE = r"[^\p{L}\p{Nl}\p{No}]"


def _pattern(e: Entry) -> str:
    return _q(f"(^|{_EDGE})" + "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in e.form) + f"({_EDGE}|$)")


def _matches(table: str, key: str, fields, entries: list[Entry]) -> str:
    long = _each(fields, lambda f: f"SELECT {key} AS row_id, '{f}' AS field, {f} AS value FROM {table}")
    words = ", ".join(f"({_q(e.category)}, {_q(e.keyword)}, {_q(e.form)})" for e in entries)
    tests = " OR ".join(f"(form = {_q(e.form)} AND contains(low, {_q(e.form)}) AND regexp_matches(low, {_pattern(e)}))"
                        for e in entries)
    return f"""SELECT DISTINCT row_id, field, value, category, keyword
        FROM (SELECT *, lower(value) AS low FROM ({long}) WHERE value IS NOT NULL)
        JOIN (VALUES {words}) k(category, keyword, form) ON contains(low, form) WHERE {tests}"""


def _extract(table: str, key: str, fields, dictionary: Dictionary) -> str:
    return f"""
        WITH m AS MATERIALIZED ({_matches(table, key, fields, dictionary.entries())}),
             k AS (SELECT field, category, keyword, arg_min(value, row_id) AS example FROM m GROUP BY ALL),
             r AS (SELECT field, category, count(DISTINCT row_id) AS matched_records FROM m GROUP BY ALL),
             n AS (SELECT count(*) AS total FROM {table})
        SELECT field, category, string_agg(keyword, ', ' ORDER BY keyword) AS found,
               any_value(matched_records) AS matched_records,
               CAST(any_value(matched_records) AS DOUBLE) / any_value(total) * 100.0 AS coverage_pct,
               string_agg(example, '|' ORDER BY keyword) AS evidence, any_value(total) AS records_processed
        FROM k JOIN r USING (field, category), n GROUP BY field, category"""


ORACLES["extract_matches"] = f"""SELECT row_id, field, category, keyword
    FROM ({_matches("documents", "doc_id", ["text", "lang"], TEXT_TERMS.entries())})"""
ORACLES["extract_summary"] = _extract("documents", "doc_id", ["text", "lang", "source"], TEXT_TERMS)
ORACLES["extract_split"] = f"SELECT *, category AS split FROM ({ORACLES['extract_summary']})"
_MANAGED = [Entry("Licence", w, low) for low, w in {w.lower(): w for w in LICENCES}.items()] + [Entry("Function word", "und", "und"), Entry("Function word", "der", "der"),
                                                                Entry("Language", "LA", "la"), Entry("Language", "el", "el")]
ORACLES["extract_managed"] = f"""SELECT row_id, field, category, keyword FROM ({_matches("documents", "doc_id", ["text"], _MANAGED)})"""
ORACLES["extract_built_in"] = _extract("documents", "doc_id", ["text", "lang", "source"], built_in(["France", "India", "Peru"]))
ORACLES["extract_custom"] = _extract("part", "p_partkey", ["p_name", "p_brand", "p_type"], PARTS)
ORACLES["joined_terms"] = f"""SELECT row_id, field, category, keyword FROM ({_matches(
    "(SELECT * REPLACE (CASE WHEN p_size > 25 THEN replace(p_name, ' ', '') ELSE p_name END AS p_name) FROM part)",
    "p_partkey", ["p_name"], Dictionary({"Name": ["small ring", "Red Widget"]}).entries(match_joined=True))})"""

_TERMS = r"""
    WITH w AS (SELECT string_split(text, ' ') AS w FROM benchmark),
         given AS (SELECT 'phrase' AS category, unnest([w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)]) AS keyword FROM w
                   UNION ALL SELECT 'part', p_name || ' ' || p_partkey FROM part),
         term AS MATERIALIZED (SELECT category, lower(k) AS form, min(k) AS keyword
                 FROM (SELECT category, trim(keyword, e' \n\r\t') AS k FROM given) WHERE k <> '' GROUP BY category, lower(k)),
         low AS MATERIALIZED (SELECT doc_id, lower(text) AS low FROM documents),
         hit AS MATERIALIZED (SELECT doc_id AS row_id, 'text' AS field, category, keyword FROM low JOIN term ON contains(low, form)
                 WHERE regexp_matches(low, '(^|[^\p{L}\p{Nl}\p{No}])' || regexp_escape(form) || '([^\p{L}\p{Nl}\p{No}]|$)'))"""
ORACLES["extract_table"] = ORACLES["extract_table_shuffled"] = f"{_TERMS} SELECT * FROM hit"
ORACLES["extract_table_counts"] = f"""{_TERMS}
    SELECT field, category, keyword, count(*) AS matched_records, count(*)::DOUBLE / (SELECT count(*) FROM documents) * 100.0 AS coverage_pct,
           (SELECT count(text) FROM documents) AS records_processed FROM hit GROUP BY ALL"""

# --- countries ----------------------------------------------------------------------------

_SPELLED = f"""(SELECT *, ([{', '.join(_q(s) for s in SPELLINGS)}])[c_nationkey % {len(SPELLINGS)} + 1] AS country FROM customer)"""
_DIM = "(VALUES " + ", ".join(f"({_q(c)}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for c, a, b in PLACES) + ") d(place, lat, lon)"
# The similarity of the misspelt names is known by hand: a score needs no SQL form of its own.
_FUZZY = "(VALUES ('Indiaa', 'India', 91), ('Keniya', 'Kenya', 91)) f(misspelt, place, score)"
_EXACT = f"""SELECT DISTINCT country AS name, place AS country, lat, lon, 100 AS score
    FROM {_SPELLED} JOIN {_DIM} ON lower(country) = lower(place)"""
_NEAR = f"""SELECT DISTINCT s.country AS name, d.place AS country, lat, lon, score
    FROM {_SPELLED} s JOIN {_FUZZY} ON s.country = misspelt JOIN {_DIM} ON f.place = d.place"""
#: Matching blocks by recursion: the longest common stretch (100 * length - place in the left text), then what is left and right of it.
ORACLES["similar_parts"] = r"""
    WITH RECURSIVE names AS (
      SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN lost WHEN 1 THEN left(p_name, place + 1) || substr(p_name, place + 1) WHEN 2 THEN w[-1] || ', ' || upper(w[1])
             WHEN 3 THEN p_brand || ' ' || p_name ELSE substr(lost, 2) END AS name
      FROM (SELECT *, p_partkey % length(p_name) AS place, string_split(p_name, ' ') AS w, left(p_name, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2) AS lost FROM part)),
    dim AS (SELECT p_name AS country, min(p_size)::DOUBLE AS lat, min(p_retailprice) AS lon FROM part GROUP BY p_name),
    exact AS (SELECT name, country, lat, lon, 100 AS score FROM names JOIN dim ON lower(name) = lower(country)),
    a AS (SELECT name, array_to_string(list_sort([t FOR t IN string_split(lower(regexp_replace(name, '[^\p{L}\p{N}_]', ' ', 'g')), ' ') IF t <> '']), ' ') AS a
          FROM names WHERE name NOT IN (SELECT name FROM exact)),
    b AS (SELECT country, array_to_string(list_sort(string_split(lower(country), ' ')), ' ') AS b FROM dim),
    pair AS (SELECT DISTINCT a, b FROM a, b WHERE a <> '' AND 2 * least(length(a), length(b)) >= 0.795 * (length(a) + length(b))),
    work AS (
      SELECT a, b, a AS x, b AS y, 0::BIGINT AS m FROM pair
      UNION ALL
      SELECT a, b, unnest([left(x, i - 1), substr(x, i + n)]), unnest([left(y, j - 1), substr(y, j + n)]), unnest([n, 0]) FROM (
        SELECT *, strpos(y, substr(x, i, n)) AS j FROM (
          SELECT *, (best + 99) // 100 AS n, (best + 99) // 100 * 100 - best AS i FROM (
            SELECT a, b, x, y, list_max(flatten([[100 * n - i FOR n IN generate_series(1, length(x) - i + 1) IF contains(y, substr(x, i, n))]
                                  FOR i IN generate_series(1, length(x))])) AS best FROM work WHERE x <> '' AND y <> '') WHERE best IS NOT NULL))),
    score AS (SELECT a, b, round_even(100 * (2.0 * sum(m) / (length(a) + length(b)))::DOUBLE, 0)::INT AS score FROM work GROUP BY a, b)
    SELECT * FROM exact UNION ALL
    SELECT name, country, lat, lon, score FROM a JOIN score USING (a) JOIN b USING (b) JOIN dim USING (country) WHERE score >= 80
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, country) = 1"""
ORACLES["geo_match"] = _EXACT
ORACLES["geo_fuzzy"] = f"{_EXACT} UNION ALL {_NEAR}"
_LAYER = f"""
    WITH m AS (SELECT c.country, lat, lon, CAST(count(*) AS DOUBLE) AS value
               FROM {_SPELLED} c JOIN ({_EXACT} UNION ALL {_NEAR}) x ON c.country = x.name GROUP BY ALL)"""
ORACLES["map_layer"] = f"""{_LAYER}
    SELECT country, lat, lon, value,
           round(CASE WHEN max(value) OVER () > min(value) OVER () THEN 100000.0 + 300000.0
               * (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) ELSE 200000.0 END, 4) AS radius FROM m"""
ORACLES["map_lines"] = f"""{_LAYER}
    SELECT * FROM (SELECT country AS start_country, lat AS start_lat, lon AS start_lon, value AS start_value,
        lead(country) OVER w AS end_country, lead(lat) OVER w AS end_lat, lead(lon) OVER w AS end_lon,
        lead(value) OVER w AS end_value FROM m WINDOW w AS (ORDER BY value DESC, country)) WHERE end_country IS NOT NULL"""
ORACLES["heat_weights"] = f"{_LAYER} SELECT lat, lon, sum(value) AS weight FROM m GROUP BY lat, lon"
ORACLES["country_coverage"] = f"""
    SELECT place AS country, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM customer) * 100.0, 2) AS coverage_pct,
           count(*) AS count, 'country' AS fields
    FROM {_SPELLED} JOIN {_DIM} ON lower(country) = lower(place) GROUP BY place"""

# --- nested data --------------------------------------------------------------------------

ORACLES["flatten_json"] = """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events"""

# --- sources and sinks ------------------------------------------------------------------------

_NA = ", ".join(map(_q, NA_TOKENS))
ORACLES["csv_round_trip"] = "SELECT doc_id, n_chars, " + ", ".join(
    f"CASE WHEN {c} NOT IN ({_NA}) THEN {c} END AS {c}" for c in ("text", "lang", "source")) + " FROM documents"
ORACLES["raw_export"] = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
ORACLES["session_round_trip"] = """SELECT *, 'c_custkey' AS key,
    (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT 3)) AS countries FROM customer"""
ORACLES["json_lines"] = """SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS "props.k" FROM events"""
ORACLES["json_document"] = """SELECT p_partkey, p_name, p_brand AS "made.p_brand", p_size AS "made.p_size" FROM part"""
ORACLES["xml_rows"] = "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey, s_acctbal::VARCHAR AS s_acctbal FROM supplier"
ORACLES["sql_source"] = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"
