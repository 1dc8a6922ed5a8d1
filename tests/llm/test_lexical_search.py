"""Ranked lexical search against a plain count of every document."""

import math
import random
import re
from collections import Counter

import pytest

import fixtures
from tableprofile.llm import lexical_search

ITEMS = "item_id long, text string, doc_id long, score long, rank int"


def terms(text):
    return re.findall(lexical_search.TERM, (text or "").translate(str.maketrans(lexical_search.CAPITALS, lexical_search.SMALL)))


def brute_force(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    count, all_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for t, n in df.items()}
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in wanted.items():
        scored = []
        for i, c in held:
            m = 75 + 25 * c.total() * count // all_terms
            s = sum(n * weight[t] * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in q.items() if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def given_items(seed):
    rng, all_texts = random.Random(seed), fixtures.texts()
    words = [w for t in all_texts for w in terms(t)[:50]]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    return items + [(50, None), (51, ""), (52, "?!"), (53, "nothingsuch"), (3, "One, ONE one two"), (54, "Été plage ab"), (55, "a" * 1000), (None, "words two")]


def run(spark, rows, items, k, **options):
    docs = spark.createDataFrame(rows, fixtures.DOCS).repartition(4)
    found = lexical_search.search(docs, spark.createDataFrame([(*i, 1, 1, 1) for i in items], ITEMS), k, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 20])
def test_against_brute_force(spark, k):
    rows, items = fixtures.rows(), given_items(2)
    assert run(spark, rows, items, k) == brute_force([r[:2] for r in rows], items, k)


def test_parts_and_small_buffers(spark, monkeypatch):
    rows, items = fixtures.rows(seed=4), given_items(3)
    monkeypatch.setattr(lexical_search, "SLICE", 3000)
    monkeypatch.setattr(lexical_search, "KEPT", 10)
    assert run(spark, rows, items, 3, part_bytes=3000) == brute_force([r[:2] for r in rows], items, 3)


def test_many_equal_scores(spark):
    """Copies: the smallest ids win, whatever the order of the rows."""
    rows = [(i, "the same text" if i < 2000 else "other words", *[None] * 8) for i in random.Random(1).sample(range(8000), 8000)]
    got = run(spark, rows, [(1, "same text")], 20)
    assert sorted((r[1], r[2]) for r in got) == [(i + 1, i) for i in range(20)]


def test_empty_tables(spark):
    rows, items = fixtures.rows(), given_items(2)
    assert run(spark, [], items, 5) == []
    assert run(spark, rows, [], 5) == []
    assert run(spark, [(1, None, *[None] * 8)], [(1, None)], 5) == []
