"""Patterns, keyword extraction and countries on small frames."""

import re

import pytest
from pyspark.sql import functions as F

from tableprofile.functions.shapes import value_pattern
from tableprofile.operators import extraction, geo, patterns
from tableprofile.operators.dictionary import COMPLIANCE, Dictionary, built_in, parse_keywords

PATTERNS = {
    "10.1.2.3": "Internal IP", "172.16.0.1": "Internal IP", "172.32.0.1": "External IP", "8.8.8.8": "External IP",
    "999.1.1.1": "External IP", "127.0.0.1": "Internal IP", "169.254.1.1": "Internal IP", "192.168.9.9": "Internal IP",
    "00:1A:2b:3C:4d:5E": "MAC Address", "00-1A-2b-3C-4d-5E": "MAC Address", "a.b+c@x-y.org": "Email",
    "a.example.org": "aaaaa.org", "host.example.org": "FQDN", "-a.org": "@a@aaa", "x.org": "FQDN",
    "Ab 12": "Aa?99", "a_b": "a?a", "É²": "A9", "漢字": "??", "?@#": "@@@", "  ab  ": "aa", " ab ": "aa",
    "": "", "Straße€": "Aaaaaa@", "ﬁ٣": "a9", "ǅ": "?", "a\tb": "a?a", "½": "?", "①Ⓐⓐ": "9Aa", "Ⅷⅷ": "Aa", "ª": "a",
    "e\u0301": "a@", "a\u203fb": "a@a", "\u2003x\u00a0": "a", "x\u2003y": "a?a", "x\x1cy": "a?a",
}
PATTERNS["a.example.org"] = "FQDN"


def python_pattern(text):
    """The rule for the shape, one character at a time."""
    out = ""
    for c in text.strip():
        if c.isupper():
            out += "A"
        elif c.islower():
            out += "a"
        elif c.isdigit():
            out += "9"
        elif re.match(r"\W", c) and not c.isspace():
            out += "@"
        else:
            out += "?"
    return out


def test_patterns(spark):
    df = spark.createDataFrame([(k,) for k in PATTERNS], "v string")
    got = {r.v: r.p for r in df.select("v", value_pattern(F.col("v")).alias("p")).collect()}
    assert got == PATTERNS


def test_shapes_match_the_rule(spark):
    named = {"Internal IP", "External IP", "MAC Address", "Email", "FQDN"}
    for text, pattern in PATTERNS.items():
        if pattern not in named:
            assert python_pattern(text) == pattern, text
    ascii_ = ["".join(chr(i) for i in range(33, 127)), "".join(chr(i) + "x" for i in range(1, 128))]
    df = spark.createDataFrame([(v,) for v in ascii_], "v string")
    for r in df.select("v", value_pattern(F.col("v")).alias("p")).collect():
        assert r.p == python_pattern(r.v)


def test_pattern_report(spark):
    df = spark.createDataFrame([(3, "ab"), (1, "cd"), (2, "x1"), (4, None)], "id int, v string")
    got = {tuple(r) for r in patterns.pattern_report(df, ["v"], "id").collect()}
    assert got == {("v", "aa", "cd", 2, 2 / 3 * 100), ("v", "a9", "x1", 1, 1 / 3 * 100)}
    assert patterns.top_pattern(df, ["v"], "id").first().pattern == "aa"
    assert patterns.pattern_report(df, ["v"]).where("pattern = 'aa'").first().example == "ab"
    flags = spark.createDataFrame([(True,), (False,)], "b boolean")
    assert {r.pattern for r in patterns.pattern_report(flags).collect()} == {"Aaaa", "Aaaaa"}


def _found(spark, dictionary, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = {}
    for r in extraction.extract_matches(df, dictionary, "id", **options).collect():
        out.setdefault(texts[r.row_id], set()).add(r.keyword)
    return out


def test_keyword_boundaries(spark):
    d = Dictionary({"c": ["US", "ISO 27001", "HR", "Web Server", "C++", "12-34", "Côte d'Ivoire", "a.b", "Éire"]})
    texts = ["bus", "_US_", "us1", "the US.", "ISO 270015", "iso 27001", "hr", "xhr", "Web Server", "WebServer", "c++!", "c+",
             "112-345", "12+34", "côte d'ivoire", "axb", "a.b", "us²", "us\nx", "ÉIRE", "hr us", "éus"]
    want = {"_US_": {"US"}, "us1": {"US"}, "the US.": {"US"}, "ISO 270015": {"ISO 27001"}, "iso 27001": {"ISO 27001"},
            "hr": {"HR"}, "Web Server": {"Web Server"}, "c++!": {"C++"}, "112-345": {"12-34"},
            "côte d'ivoire": {"Côte d'Ivoire"}, "a.b": {"a.b"}, "us\nx": {"US"}, "ÉIRE": {"Éire"}, "hr us": {"HR", "US"}}
    assert _found(spark, d, texts) == want
    joined = _found(spark, d, texts, match_joined=True)
    assert joined == {**want, "WebServer": {"Web Server"}}


def test_matches_agree_with_the_boundary_rule(spark):
    import random
    rng = random.Random(1)
    words = ["us", "US", "uk", "new york", "sud-est", "été"]
    parts = words + ["a", "1", "_", " ", "-", ".", "é", "\n", "x", "²"]
    texts = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(1500)})

    def rule(term, text):
        t, edge = re.escape(term.lower()), r"[\s\W_\d]"
        return re.search(f"(^|{edge}){t}({edge}|$)", text.lower()) is not None

    want = {t: {w for w in ("US", "uk", "new york", "sud-est", "été") if rule(w, t)} for t in texts}
    got = _found(spark, Dictionary({"c": words}), texts)
    assert got == {t: ws for t, ws in want.items() if ws}


def test_extract_summary(spark):
    df = spark.createDataFrame([(2, "HR and IT", "x"), (1, "the hr desk", None), (3, None, "IT"), (4, "none", "y")],
                               "id int, a string, b string")
    d = Dictionary({"Unit": ["HR", "IT"], "Other": ["desk"]})
    got = {(r.field, r.category): r for r in extraction.extract_summary(df, d, row_id="id").collect()}
    unit = got[("a", "Unit")]
    assert unit.found == ["HR", "IT"] and unit.evidence == ["the hr desk", "HR and IT"]
    assert (unit.matched_records, unit.coverage_pct, unit.records_processed) == (2, 50.0, 3)
    assert got[("b", "Unit")].found == ["IT"] and set(got) == {("a", "Unit"), ("a", "Other"), ("b", "Unit")}
    parts = extraction.split_by_category(extraction.extract_summary(df, d, row_id="id"), d)
    assert parts["Other"].count() == 1


def test_dictionary():
    assert parse_keywords(" a, ,b ,") == ["a", "b"]
    d = Dictionary({"x": ["hr", "HR", " Sales "]})
    assert d.categories == {"x": ["HR", "Sales"]}
    assert d.add("y", ["k"]).replace("y", ["z"]).categories["y"] == ["z"]
    assert d.remove("x").categories == {}
    for bad in (lambda: d.add("x", ["k"]), lambda: d.add("", ["k"]), lambda: d.add("y", [])):
        with pytest.raises(ValueError):
            bad()
    assert len(COMPLIANCE) == len(set(COMPLIANCE)) and "GDPR" in COMPLIANCE
    assert set(built_in(["France"]).categories) == {"Countries", "Regions", "Compliance", "Business Units"}


def test_country_coverage(spark):
    df = spark.createDataFrame([("France, peru", "France"), ("x", "PERU"), (None, None), ("frances", "")], "a string, b string")
    got = [tuple(r) for r in extraction.country_coverage(df, ["France", "Peru"]).collect()]
    assert got == [("France", 50.0, 2, "a, b"), ("Peru", 50.0, 2, "a, b")]


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([("France", 1.0, 2.0), ("United Kingdom", 3.0, 4.0), ("Korea (South)", 5.0, 6.0),
                                  ("Guinea", 7.0, 8.0)], "country string, lat double, lon double")


def test_country_matching(spark, dim):
    names = spark.createDataFrame([("france",), ("Kingdom United",), ("South Korea",), ("Frnace",), ("Fra",), ("Atlantis",),
                                   (None,), ("!!",)], "c string")
    got = {r.name: (r.country, r.score) for r in geo.match_countries(names, "c", dim).collect()}
    assert got == {"france": ("France", 100), "Kingdom United": ("United Kingdom", 100),
                   "South Korea": ("Korea (South)", 100), "Frnace": ("France", 83)}
    exact = geo.match_countries(names, "c", dim, fuzzy=False).collect()
    assert [r.name for r in exact] == ["france"]


def test_map_layers(spark, dim):
    df = spark.createDataFrame([("France", 10.126), ("Guinea", 30.0), ("South Korea", 20.0), ("Nowhere", 5.0)], "c string, v double")
    layer = geo.map_layer(df, "c", dim, "v")
    assert {(r.country, r.value) for r in layer.collect()} == {("France", 10.13), ("Guinea", 30.0), ("South Korea", 20.0)}
    assert {r.country: round(r.radius) for r in layer.collect()}["Guinea"] == 400000
    assert {(r.start_country, r.end_country) for r in geo.map_lines(layer).collect()} == {
        ("Guinea", "South Korea"), ("South Korea", "France")}
    assert {(r.lat, r.weight) for r in geo.heat_weights(layer).collect()} == {(1.0, 10.13), (7.0, 30.0), (5.0, 20.0)}
    assert geo.map_layer(df.where("c = 'France'"), "c", dim, "v").first().radius == 200000.0
    assert {r.radius for r in geo.map_layer(df, "c", dim).collect()} == {200000.0}


def test_map_lines_across_partitions(spark):
    """Sorted over many tasks, with ties and missing values: the same chain as in one."""
    rows = [(f"c{i:04d}", float(i), -float(i), None if i % 50 == 0 else float(i % 37)) for i in range(3000)]
    layer = spark.createDataFrame(rows, "country string, lat double, lon double, value double").repartition(6)
    from tableprofile.operators import geo
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r.start_country, r.end_country) for r in geo.map_lines(layer).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    chain = [r[0] for r in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))]
    assert got == set(zip(chain, chain[1:])) and len(got) == 2999


@pytest.mark.parametrize("values", [["bb", "aa", "cc"], ["aa", "cc", "bb"], ["cc", "bb", "aa"]])
def test_pattern_example_of_rows_that_share_an_id(spark, values):
    df = spark.createDataFrame([(1, v) for v in values] + [(2, "a0"), (None, "a1")], "id long, v string").coalesce(1)
    got = {r.pattern: r.example for r in patterns.pattern_report(df, ["v"], "id").collect()}
    assert got == {"aa": "aa", "a9": "a0"}
