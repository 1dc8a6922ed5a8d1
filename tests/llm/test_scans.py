"""Scans of single texts: counts, rules, languages, licences; and mixing, chat format, decontamination."""

import os
import random
import re
import time
from collections import Counter

import pytest
from fixtures import DOCS, prose, rows
from pyspark.sql import functions as F

from tableprofile.llm import chat_format, decontamination, language_id, licence_scan, mixing, quality_rules
from tableprofile.llm.queries import vocabulary
from tableprofile.llm.token_counts import count_text, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = vocabulary("byte_bpe_50k.json")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


@needs_vocabulary
def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(VOCABULARY)
    given = rows()
    found = token_counts(spark.createDataFrame(given, DOCS), VOCABULARY, limit=500).collect()
    want = [(r[0], len((r[1] or "").encode()), len(known.encode(r[1] or "", add_special_tokens=False).ids)) for r in given]
    assert Counter(map(tuple, found)) == Counter((*w, w[2] > 500) for w in want)


@needs_vocabulary
def test_token_counts_of_odd_texts():
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(VOCABULARY)
    rng = random.Random(3)
    odd = ["a<|endoftext|>b <|endoftext|><|endoftext|>", "it's  we'll\n\n x", "\x1c\x85　 a", "a" * 3000, ""]
    odd += ["".join(rng.choices("ab' \n\t1.é\x1c　 日", k=rng.randint(0, 14))) for _ in range(3000)]
    odd += ["".join(chr(c) for c in range(at, at + 300) if not 0xD800 <= c < 0xE000) for at in range(0, 0x3000, 300)]
    assert [count_text(t, VOCABULARY) for t in odd] == [len(e.ids) for e in known.encode_batch(odd, add_special_tokens=False)]


def brute_rules(text):
    words = WORD.findall(text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside)


def test_quality_rules(spark):
    few = [w.upper() + "***" for w in prose(random.Random(0), 30).split()]
    junk = [(5000 + i, " ".join(random.Random(i).choices(few, k=80)), "en", "s", 0, "x", 0, 0, 0, "") for i in range(20)]
    given = rows() + junk
    docs = spark.createDataFrame(given, DOCS).repartition(3)
    labels = spark.createDataFrame([(r[0], 0 if (r[0] or 0) >= 5000 else 1, 0) for r in given] + [(None, 1, 0), (77777, None, None)], "doc_id long, quality int, toxic int")
    ratios = quality_rules.ratio_table(docs, quality_rules.trusted_sample(labels))
    found = quality_rules.quality_rules(docs, ratios).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter((r[0], *brute_rules(r[1])) for r in given)
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    assert not any(r.kept for r in found if (r.doc_id or 0) >= 5000)
    assert all(r.kept for r in found if (r.doc_id or 0) < 5000 and not r.base_failed)
    none = quality_rules.ratio_table(docs.limit(0), quality_rules.trusted_sample(labels.limit(0)))
    assert abs(none).max() == 0 and quality_rules.quality_rules(docs.limit(0), none).count() == 0


def test_quality_rules_held_out(spark):
    """Fitted on every second labelled row, judged on the others."""
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("no sample tables")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ratios = quality_rules.ratio_table(docs, quality_rules.trusted_sample(labels.where("doc_id % 2 = 0")))
    judged = quality_rules.quality_rules(docs, ratios).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.kept for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in judged if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


LANGUAGES = {"aa": "abcde", "bb": "vwxyz", "cc": "klmno"}


def spoken(rng, lang, n=20):
    return " ".join("".join(rng.choices(LANGUAGES[lang], k=5)) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(1)
    given = [(i, spoken(rng, lang := rng.choice(list(LANGUAGES))), lang, f"{lang}.host{i % 3}.{lang}", 0, "x", 0, 0, 0, "") for i in range(300)]
    docs = spark.createDataFrame(given, DOCS)
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    assert model.languages == ["aa", "bb", "cc", "und"]
    odd = [(900, None, "aa", "aa.host0.aa"), (901, "", "aa", None), (902, "ab", None, None), (None, spoken(rng, "bb"), None, None), (903, "0123 4567 8901 2345 6789", None, None),
           (904, spoken(rng, "aa"), "BB", None)]
    docs = docs.unionByName(spark.createDataFrame([(*r, 0, "x", 0, 0, 0, "") for r in odd], "doc_id long, text string, lang string, source string, n_chars long, id string, version int, n long, key int, line string"))
    host = F.col("source")
    found = language_id.identify(docs, model, declared=F.col("lang"), host=host, suffix=language_id.host_suffix(host))
    assert found.columns == ["doc_id", "language", "probability", "text_language", "kept"]
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == 306 and all(got[r[0]].language == r[2] and got[r[0]].kept for r in given)
    assert [(got[i].language, got[i].kept) for i in (900, 901, 902, None, 903, 904)] == [
        ("und", False), ("und", False), ("und", False), ("bb", True), (got[903].language, False), ("aa", True)]
    assert language_id.identify(docs.limit(0), model, host=host).count() == 0
    bare = language_id.fit(docs.limit(0))
    assert bare.languages == ["und"] and {r.kept for r in language_id.identify(docs, bare).collect()} == {False}


def test_host_prior_decides_a_text_without_a_side(spark):
    """A text half in one language, half in another, goes with its host; the prior of a new host with its domain's."""
    rng = random.Random(2)
    sure = [(i, spoken(rng, lang := ("aa", "bb")[i % 2]), lang, f"www.{lang}.org") for i in range(400)]
    mixed = spoken(rng, "aa", 1) + " " + spoken(rng, "bb", 1)
    docs = spark.createDataFrame(sure + [(1000, mixed, None, "www.aa.org"), (1001, mixed, None, "www.bb.org"), (1002, mixed, None, "new.bb.org")], "doc_id long, text string, lang string, host string")
    found = language_id.identify(docs, language_id.fit(docs), host=F.col("host"))
    assert {r.doc_id: r.language for r in found.where("doc_id >= 1000").collect()} == {1000: "aa", 1001: "bb", 1002: "bb"}


def test_page_parts(spark):
    html = '<!doctype html><HTML class="a" lang="de-AT"><head><script>var t="</p>";</script></head><body><!-- no --><p>Ja<b>wohl</b></p></body></html>'
    row = spark.createDataFrame([(html, "https://user@Blog.Example.ORG:80/de/1?x#y")], "h string, u string").select(
        language_id.page_text(F.col("h")), language_id.page_language(F.col("h")), language_id.url_host(F.col("u")), language_id.host_suffix(language_id.url_host(F.col("u")))).first()
    assert (row[0].split(), *row[1:]) == (["Ja", "wohl"], "de", "blog.example.org", "org")


def test_licence_scan(spark):
    rng = random.Random(6)
    plain = [(i, "\n".join(prose(rng, 30) for _ in range(3))) for i in range(60)]
    notices = [(family, t) for family, all_ in licence_scan.TEMPLATES.items() for t in all_]
    held = [(100 + i, f"{prose(rng, 20)}\n{t}\n{prose(rng, 20)}") for i, (_, t) in enumerate(notices)]
    odd = [(500, None), (501, ""), (502, "\n \n"), (503, "license the of version in a rights all"), (None, "All rights reserved."), (504, "All rights reserved.\nAll rights reserved.")]
    docs = spark.createDataFrame(plain + held + odd, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("row", F.lit(1))
    model = licence_scan.fit(docs)
    got = {r.doc_id: r for r in licence_scan.scan(docs, model).collect()}
    assert all(got[i].licences == "" and got[i].n_paragraphs == 3 for i, _ in plain)
    right = [got[100 + i].licences == family for i, (family, _) in enumerate(notices)]
    assert sum(right) >= 0.9 * len(right)
    assert [(got[i].licences, got[i].n_licence) for i in (500, 501, 502, 503, None, 504)] == [("", 0), ("", 0), ("", 0), ("", 0), ("proprietary", 1), ("proprietary", 2)]
    assert [got[i].n_paragraphs for i in (500, 501, 502)] == [0, 0, 0]
    assert licence_scan.scan(docs.limit(0), model).count() == 0
    assert licence_scan.fit(docs.limit(0)).families[-1] == "unknown"


def test_chat_format(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "&lt;s>", "&amp;", "a\nb", "", None, "<", "[", "plain", "<|im_end|>", "x<|im_end|>\n"]
    rng = random.Random(1)
    turns = [(c, t, rng.choice(["user", "assistant", *hard]), rng.choice(hard)) for c in [*range(60), None] for t in range(rng.randint(1, 6))]
    turns += [(0, 0, "user", "again"), (0, 0, "user", "again"), (1, None, "assistant", "first")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x")).withColumn("n", F.lit(1))
    found = chat_format.format_conversations(df).withColumn("turns", chat_format.parse(F.col("formatted"))).withColumn(
        "loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    want = {}
    for c, t, role, text in sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in found} == want
    assert {r.conv_id: r.loss for r in found} == {c: "".join(x for role, x in v if role == "assistant") for c, v in want.items()}
    assert all(r.identical and r.n_turns == len(r.turns) for r in found)
    for r in found:     # control strings only where the template puts them
        assert sum(r.formatted.count(s) for s in chat_format.CONTROL) == 2 * r.n_turns
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def brute_hits(text, items, size=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        if item is None or not v:
            continue
        for i in range(max(1, len(v) - size + 1)):
            part = v[i:i + size]
            for j in range(len(w) - len(part) + 1):
                if w[j:j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontaminate(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([1, 4, 9, 10, 11, 25]), 30)) for i in range(12)] + [(50, None), (None, prose(rng, 12)), (51, ""), (52, "?!")]
    items.append((53, items[5][1].upper()))
    pool = [t for _, t in items if t]
    given = []
    for i in range(80):
        parts = [prose(rng, rng.randint(0, 15), 30)]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(pool).split(" ")
            cut = rng.randint(0, 3)
            parts += [" ".join(w[cut:]), prose(rng, rng.randint(0, 5), 30)]
        given.append((i, ", ".join(parts)))
    given += [(100, None), (101, ""), (None, pool[3]), (5, pool[4] + " again"), given[7], given[7], (102, prose(rng, 20_000) + " " + pool[5])]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("version", F.lit(2)).withColumn("w", F.lit(3))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    found = decontamination.decontaminate(docs, bench).collect()
    assert Counter((r[0], r.n_words, r.n_hit, tuple(r["items"])) for r in found) == Counter((d, *(x if isinstance(x, int) else tuple(x) for x in brute_hits(t, items))) for d, t in given)
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontamination.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_benchmark_words(spark):
    rng = random.Random(18)
    odd = [chr(c) for c in range(128)] + list("ÀÉßéΣςİıǅ\u212aⅣⓐ\x80\u00a0\u2028中😀")
    texts = [None, "", " ", "..a", "B!!", "ÉCOLE École ecole", "\u212aELVIN K", *("".join(rng.choices(odd, k=rng.randint(1, 60))) for _ in range(300)), *map(chr, range(128))]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", decontamination.words(F.col("t")).alias("w")).collect()
    assert {r.i: r.w for r in found} == {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t in enumerate(texts)}


def test_cutting_words_costs_little(spark):
    """Cutting takes about as long as one translate of the texts; matching runs of a negated class of ranges took six times as long."""
    rng = random.Random(19)
    text = F.concat(F.lit(prose(rng, 20_000) + " é "), F.col("id").cast("string"))
    docs = spark.range(0, 100, 1, 4).select(text.alias("text")).persist()
    docs.count()

    def seconds(column):
        took = []
        for _ in range(4):
            start = time.perf_counter()
            docs.agg(F.sum(column)).first()
            took.append(time.perf_counter() - start)
        return min(took)

    cut, plain = seconds(F.size(decontamination.words(F.col("text")))), seconds(F.length(F.translate("text", "ABC", "abc")))
    docs.unpersist()
    assert cut < 4 * plain, (cut, plain)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha beta far far far far far gamma"), (4, "alpha alpha beta")], "doc_id long, text string")
    wanted = decontamination.item_windows(spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string"))
    near = {r.id: len(r.hits) for r in decontamination.matches(docs, wanted, slop=2).collect()}
    assert {i for i, n in near.items() if n} == {1, 2}
    exact = {r.id: len(r.hits) for r in decontamination.matches(docs, wanted).collect()}
    assert not any(exact.values())


def test_mixing(spark):
    rng = random.Random(9)
    given = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(3000)]
    given += [(5, "x y", "a"), (5, "x y", "a"), (None, "x", "b"), (None, None, None), (9000, None, "empty"), (9001, "", "empty")]
    df = spark.createDataFrame(given, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("start", F.lit(1))
    mixed = mixing.mix(df, bucket_rows=40)
    found = mixed.collect()
    assert Counter(map(repr, found)) == Counter(map(repr, mixing.mix(df.repartition(7)).collect()))
    assert len(found) == len(given)
    size, taken, target = Counter(), Counter(), {}
    for r in found:
        size[r.source] += r["size"]
        taken[r.source] += r["size"] * len(r.positions)
        target[r.source] = r.target
        assert len(r.positions) <= 3 and all(0 <= p < 1 for p in r.positions)
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(total)
    weight = dict(zip(sorted(s for s in size if s is not None) + [None], [5, 2, 1] * 3))
    level = max(target[s] / weight[s] for s in size)
    for s in size:
        assert target[s] == pytest.approx(min(3 * size[s], level * weight[s])) and abs(taken[s] - target[s]) <= 40
    ordered = mixing.schedule(mixed).select("position", "source").collect()
    assert [r.position for r in ordered] == sorted(r.position for r in ordered) and len(ordered) == sum(len(r.positions) for r in found)
    half = [r.source for r in ordered[:len(ordered) // 2]]
    assert half.count("a") > 0.52 * sum(r.source == "a" for r in ordered)      # its rate falls from 1.2 to 0.8
    assert mixing.mix(df.limit(0)).count() == 0


def test_curriculum_is_the_inverse_of_demand(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a") for i in range(400)], "doc_id long, text string, source string")
    p = sorted(x for r in mixing.mix(df, schedule=((0.5, 1.5),)).collect() for x in r.positions)
    for i in (0, 100, 200, 399):
        assert 0.5 * p[i] + 0.5 * p[i] ** 2 == pytest.approx((i + 0.5) / 400)


