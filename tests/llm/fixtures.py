"""Small tables with the awkward cases, shared by the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, version int, n long, key int, line string"


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join("".join(rng.choices("abcdefghio", k=rng.randint(2, 7))) + str(rng.randrange(vocabulary)) for _ in range(words))


def texts(seed: int = 1, groups: int = 8) -> list[str]:
    """Prose, exact and near copies, repeated lines, junk, empty, odd characters and one very long text."""
    rng = random.Random(seed)
    out = ["", " ", "\n\n", "one", "two words", "Été à la plage\t\x0b", "a" * 1000, "ab " * 400, "\U0001f600 emoji \U0001f600\n" * 3]
    shared = prose(rng, 40)
    for _ in range(groups):
        base = "\n".join(prose(rng, rng.randint(8, 40)) for _ in range(4))
        out += [base, base, base.upper(), base.replace(" ", "  ", 3)]
        for changes in (1, 2, 5, 12):
            words = base.split(" ")
            for _ in range(changes):
                words[rng.randrange(len(words))] = prose(rng, 1)
            out.append(" ".join(words))
        out.append(prose(rng, 60) + "\n" + shared)
    out.append(prose(rng, 20_000) + "\n" + shared)
    return out


def rows(seed: int = 1, nulls: bool = True) -> list[tuple]:
    """Rows of DOCS: the texts, some null cells, repeated rows; other columns have clashing names."""
    out = [(i, t, "en", f"s{i % 3}", len(t), "x", i, i, i, "y") for i, t in enumerate(texts(seed))]
    if nulls:
        out += [(1000, None, None, None, None, None, None, None, None, None), (1001, out[20][1], None, None, None, None, None, None, None, None)]
        out += [out[12], out[12]]
    random.Random(seed).shuffle(out)
    return out
