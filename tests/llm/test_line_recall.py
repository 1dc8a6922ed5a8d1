"""Recall of the fuzzy line deduplication, judged by edit similarity alone."""

import random

from tableprofile.llm import line_dedup


def changed(rng, line, words=0.0, letters=0.0):
    """The line with a share of its words replaced by others of their length, or of its letters, at least one."""
    parts, letter = line.split(" "), lambda: rng.choice("abcdefghijklmnop")
    if words:
        for i in rng.sample(range(len(parts)), max(1, int(words * len(parts)))):
            parts[i] = "".join(letter() for _ in parts[i])
        return " ".join(parts)
    out = list(line)
    for i in rng.sample(range(len(out)), max(1, int(letters * len(out)))):
        out[i] = letter()
    return "".join(out)


#: words of a line, share of words or letters replaced, least recall. SimHash blocks find about 0.85 to 0.99 for lines of at
#: least 98 % edit similarity (the first three). The MinHash keys of before had floors of 0.97, 0.97, 0.97; 0.97 for
#: the fourth, 0.9 to 0.97 for replaced words, 0.55 to 0.7 for the last four: what a block of SimHash bits loses.
KINDS = [(10, {"letters": 0.0001}, 0.75), (20, {"letters": 0.0001}, 0.93), (50, {"letters": 0.0001}, 0.97), (6, {"letters": 0.0001}, 0.4),
         (50, {"words": 0.0001}, 0.95), (20, {"words": 0.0001}, 0.65), (10, {"words": 0.0001}, 0.25), (6, {"words": 0.0001}, 0.1),
         (20, {"words": 0.1}, 0.2), (50, {"words": 0.1}, 0.2), (20, {"words": 0.15}, 0.05), (50, {"words": 0.15}, 0.05), (50, {"words": 0.2}, 0.0),
         (20, {"letters": 0.05}, 0.05), (50, {"letters": 0.05}, 0.05), (2, {"letters": 0.0001}, 0.05), (3, {"letters": 0.0001}, 0.1)]


def recalls(spark, pairs=150):
    rng, given, kinds = random.Random(3), [], {}
    for number, (n, change, _) in enumerate(KINDS):
        for i in range(pairs):
            line = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
            other = changed(rng, line, **change)
            if line_dedup.similar(line, other, 80):
                key = 2 * (number * pairs + i)
                kinds[key + 1] = number
                given += [(key, line), (key + 1, other)]
    found = line_dedup.dedup_lines(spark.createDataFrame(given, "doc_id long, text string"))
    removed = {r.doc_id for r in found.where("n_removed > 0").collect()}
    assert removed <= set(kinds)        # nothing else is linked
    out = []
    for number in range(len(KINDS)):
        asked = [k for k in kinds if kinds[k] == number]
        out.append((len(asked), sum(k in removed for k in asked) / max(1, len(asked))))
    return out


def test_recall_against_edit_similarity(spark):
    found = recalls(spark)
    print(*zip(KINDS, found), sep="\n")
    for (n, change, least), (asked, recall) in zip(KINDS, found):
        assert asked >= 20 and recall >= least, (n, change, asked, recall)
