"""Keywords from a table against the dictionary of the plan and a plain regular expression."""

import random
import re

import pytest

from tableprofile.operators import extraction, keyword_table
from tableprofile.operators.dictionary import Dictionary

TEXTS = ["ISO 270015 and HR", "bus us, US_", "web server; WebServer x", "a.b? c++ (c++) C#", "²HR HR² hr3", "naïve Ärger ärger", "us", "", None,
         "no 27001 here 9001", "Web  Server", "\x01us\x02", "HR\nus", "x" * 5000 + " hr", "c++c++", "-9001-"]
CATEGORIES = {"A": ["ISO 27001", "HR", "us", "Web Server", "c++", "C#", "Ärger", "27001"], "B": ["hr", "a.b?", "9001", "(c++)", " us "]}


def given(spark):
    return spark.createDataFrame([(c, k) for c, ks in CATEGORIES.items() for k in ks] + [("A", "  "), ("A", None), ("B", "HR")], "category string, keyword string")


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
@pytest.mark.parametrize("joined", [False, True])
def test_same_as_the_dictionary(spark, rows, broadcast_bytes, joined):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    want = rows(extraction.extract_matches(df, Dictionary(CATEGORIES), "id", match_joined=joined))
    got = rows(keyword_table.extract_matches_of(df, given(spark), "id", match_joined=joined, broadcast_bytes=broadcast_bytes))
    assert sorted((r, f, c, k.lower()) for r, f, c, k in got) == sorted((r, f, c, k.lower()) for r, f, c, k in want) and len(got) > 15


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_random_texts(spark, rows, broadcast_bytes):
    rng = random.Random(3)
    parts = ["ab", "b", "abc", " ", " ", ".", "-", "1", "é", "²", "_", "\n", "Ab", "(", "c"]
    make = lambda n: "".join(rng.choices(parts, k=n))
    texts = [make(rng.randint(0, 20)) for _ in range(300)]
    words = sorted({make(rng.randint(1, 4)).strip().lower() for _ in range(200)} - {""})
    edge = r"[^\W\d_]|²"
    want = sorted((i, "text", "k", w) for i, t in enumerate(texts) for w in words
                  if re.search(f"(?<!{edge}){re.escape(w)}(?!{edge})".replace(f"(?<!{edge})", r"(?<![^\W\d_])(?<!²)"), t.lower()))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([("k", w) for w in words], "category string, keyword string")
    assert rows(keyword_table.extract_matches_of(df, table, "id", broadcast_bytes=broadcast_bytes)) == sorted(want, key=repr)


def test_counts_and_limits(spark, monkeypatch):
    df = spark.createDataFrame([(1, "HR and us"), (2, "hr"), (3, None), (4, "x")], "id long, text string")
    got = {r.keyword: tuple(r)[3:] for r in keyword_table.extract_counts_of(df, given(spark).where("category = 'A'"), "id").collect()}
    assert got == {"HR": (2, 50.0, "HR and us", 3), "us": (1, 25.0, "HR and us", 3)}
    assert keyword_table.extract_matches_of(df.where("false"), given(spark), "id").count() == 0
    assert keyword_table.extract_matches_of(df, given(spark).where("false"), "id").count() == 0
    monkeypatch.setattr(keyword_table, "MOST_BARE", 1)
    with pytest.raises(ValueError):
        keyword_table.extract_matches_of(df, given(spark), "id")


def test_keywords_that_share_their_words_make_no_pairs(spark, rows):
    """Texts that hold the words of all keywords, but few of the keywords: only what may be a whole keyword goes on."""
    words = spark.createDataFrame([("part", f"large ring {i}") for i in range(2_000)], "category string, keyword string")
    df = spark.createDataFrame([(i, f"a large ring {i + 1_990} and a large, ring; ring large") for i in range(200)], "id long, text string")
    table = keyword_table.keyword_table(words)
    heads = table.select("head", "runs", "pre", "post").distinct()
    assert heads.count() == 4       # of one to four digits
    texts = keyword_table._long(df, "id", None).selectExpr("*", "xxhash64(value) AS text")
    places = keyword_table._places(texts, heads, 2, 15)
    assert places.count() == 200
    assert keyword_table._candidates(places.join(heads, "head")).count() == 800     # not 200 times 2,000
    # a keyword may end within a number
    want = [(i, f"large ring {n}") for i in range(200) for n in {str(i + 1_990)[:k] for k in (1, 2, 3, 4)} if int(n) < 2_000]
    assert rows(keyword_table.extract_matches_of(df, words, "id", broadcast_bytes=0), "row_id", "keyword") == sorted(want, key=repr)


def test_evidence_is_fetched_for_keywords_only(spark):
    df = spark.createDataFrame([(2, "us two"), (1, "us " + "." * 500 + " us"), (1, "us"), (None, "hr")], "id long, text string")
    got = {r.keyword: (r.matched_records, r.evidence) for r in keyword_table.extract_counts_of(df, given(spark).where("category = 'A'"), "id").collect()}
    assert got["us"][0] == 3 and got["us"][1].startswith("us") and got["us"][1] != "us two" and got["HR"] == (1, None)
