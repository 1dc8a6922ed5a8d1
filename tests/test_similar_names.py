"""Similar names against the standard library's matching blocks, over all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from tableprofile.operators import similar_names


def ratio(a, b):
    return round(100 * SequenceMatcher(None, a, b, autojunk=False).ratio()) if a and b else 0


def test_matching_blocks():
    rng = random.Random(2)
    pairs = [("".join(rng.choices("abcd é\U0001f600", k=rng.randint(0, 15))), "".join(rng.choices("abcd é\U0001f600", k=rng.randint(0, 15)))) for _ in range(3000)]
    left, right = map(list, zip(*pairs))
    assert similar_names.token_sort_scores(left, right).tolist() == [ratio(a, b) for a, b in pairs]
    assert similar_names.token_sort_scores([], []).tolist() == []


@pytest.mark.parametrize("accept", [80, 60, 95])
def test_no_pair_is_missed(spark, accept):
    rng = random.Random(accept)
    known = sorted({"".join(rng.choices("abcde ", k=rng.randint(1, 14))) for _ in range(120)})
    names = set()
    for k in known * 3:
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(k) + 1)
            k = k[:at] + rng.choice(["", "x", "b", "-"]) + k[at + rng.randint(0, 1):]
        names.add(k.upper() if rng.random() < 0.2 else k)
    names = sorted(names) + ["?!", ""]
    plain = lambda s: " ".join(sorted("".join(c if c.isalnum() or c == "_" else " " for c in s).lower().split()))
    want = []
    for n in names:
        score, best = max(((ratio(plain(n), plain(k)), k) for k in known), key=lambda t: (t[0], [-ord(c) for c in t[1]] + [1]))
        best = min(k for k in known if ratio(plain(n), plain(k)) == score)
        if score >= accept:
            want.append((n, best, score))
    df = spark.createDataFrame([(n,) for n in names] + [(None,), (names[0],)], "name string")
    got = similar_names.similar_names(df, spark.createDataFrame([(k,) for k in known], "name string"), accept)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert similar_names.similar_names(df, spark.createDataFrame([], "name string"), accept).count() == 0
