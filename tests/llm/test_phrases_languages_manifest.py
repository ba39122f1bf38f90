"""Phrase mining, language prediction and the manifest against plain loops, with nulls, empty and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import collocations, language_id, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# Phrases


def mined(rows, longest=5, least=100, percent=100, best=2000):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = {(lang, p[i : i + k]) for (lang, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= percent * f[lang, p[i : i + k]]}
    by_lang = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            by_lang[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in by_lang.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:best])}


def chatter(n, seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "Ça", "und", "É", "x\x1cy", "日本", "word", " ", "#"]
    marks = [" ", "  ", "\t", ", ", ".", "\n", "\x0b", "! ", " "]
    return [(i, "".join(r.choice(vocabulary) + r.choice(marks) for _ in range(r.randint(0, 120))), r.choice(["en", "fr", None, "und"]), "s", 1) for i in range(n)]


@pytest.mark.parametrize("options", [{"least": 12}, {"least": 6, "percent": 70}, {"least": 3, "longest": 3, "best": 7}])
@pytest.mark.parametrize("block", [40, 1_000_000])
def test_collocations(spark, options, block):
    rows = chatter(120, 5) + [(900, None, "en", None, None), (901, "", None, None, 0), (902, "a b a b " * 400, "en", None, 0), (903, " \t. ,", "de", "s", 1)]
    rows += [(904, "one two three " * 30 + ". zwei drei", "xx", None, 1)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).withColumn("words", F.lit(1))
    got = [tuple(r) for r in collocations.collocations(docs, block=block, **options).collect()]
    assert len(set(got)) == len(got)
    assert set(got) == mined([(r[2], r[1]) for r in rows], **options)


def test_collocations_of_sliced_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 7)
    b = collocations.Block()
    text = "Aa bb, cc  ddddddddddddd e\tf. " * 9
    words = [w for p in re.split(r"[.,]", text.lower()) for w in [*p.split(), "\n"]]
    seq = b.sequence(text)
    names = [w.decode() for w in b.words()]
    assert [names[i] if i >= 0 else "\n" for i in seq] == words


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "a b", "en", None, 3)], SCHEMA)).count() == 0


def test_cut_is_exact(spark):
    r = random.Random(3)
    rows = []
    for _ in range(300):
        k = r.randint(2, 5)
        a = r.randint(100, 10 ** r.randint(3, 13))
        sizes = lambda: [r.randint(a, a * 10) for _ in range(k - 1)]  # noqa: B023, E731
        rows.append((a, r.randint(a, 10**15), sizes(), sizes()))
    df = spark.createDataFrame(rows, "a long, n long, heads array<long>, tails array<long>")
    got = [tuple(x.c) for x in df.select(collocations.cut(*map(F.col, df.columns)).alias("c")).collect()]
    assert got == [min((1000 * a * n // (h[k] * t[len(h) - 1 - k]), k + 1, h[k], t[len(h) - 1 - k]) for k in range(len(h))) for a, n, h, t in rows]


# Languages


def spoken(lang, n, r):
    parts = {"en": ["the", "ing", "th", "er", "and", "sh"], "de": ["sch", "ein", "ung", "ß", "der", "ö"], "es": ["ción", "ñ", "de", "que", "ll"], "el": ["και", "λο", "γος"], "hi": ["है", "में", "और"]}[lang]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("langs", [("en", "de"), ("en", "de", "es", "el", "hi")])
def test_languages(spark, langs):
    r = random.Random(8)
    rows = [(i, spoken(langs[i % len(langs)], r.randint(3, 60), r), langs[i % len(langs)], "s", 1) for i in range(500)]
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "12 ½ ² --", "de", "s", 1), (903, spoken("en", 90_000, r), None, None, None), (None, rows[0][1], "en", "s", 1), (904, rows[0][1], langs[0], "s", 1), (904, rows[0][1], langs[0], "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("p", F.lit(1))
    out = language_id.languages(docs, per_lang=40).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x for x in out}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(500))
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.98
    assert all(0 <= x.score <= 1 and x.lang_pred in {*langs, "und"} for x in out)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903].lang_pred == "en" and got[None].lang_pred == rows[0][2]
    assert got[904].score == got[0].score


def test_held_out_labels_and_languages_are_never_read(spark):
    r = random.Random(9)
    rows = [(i, spoken(("en", "de")[i % 2], 20, r), ("en", "de")[i % 2], "s", 1) for i in range(200)]
    lied = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "other", None) for i, t, lang, _, _ in rows]
    a, b = (sorted(map(tuple, language_id.languages(spark.createDataFrame(x, SCHEMA), per_lang=30).collect())) for x in (rows, lied))
    assert a == b


def test_ambiguous_texts_are_flagged(spark):
    r = random.Random(10)
    rows = [(i, spoken(("en", "de")[i % 2], 20, r), ("en", "de")[i % 2], "s", 1) for i in range(200)]
    rows.append((1000, " ".join(spoken(x, 1, r) for x in ("en", "de") * 40), None, None, None))
    got = {x.doc_id: x for x in language_id.languages(spark.createDataFrame(rows, SCHEMA), per_lang=30).collect()}
    assert abs(got[1000].score - 0.5) < 0.45 and got[1000].score < min(got[i].score for i in range(200))
    assert sum(got[i].ambiguous for i in range(200)) == 0


def test_languages_of_nothing(spark):
    assert language_id.languages(spark.createDataFrame([], SCHEMA)).count() == 0
    none = language_id.languages(spark.createDataFrame([(1, "words here", None, None, None), (2, "--", "en", None, None)], SCHEMA)).collect()
    assert [(x.lang_pred, x.score) for x in none] == [("und", 0.0)] * 2
    one = language_id.languages(spark.createDataFrame([(i, "words here" if i else None, "en", None, None) for i in range(9)], SCHEMA)).collect()
    assert {x.doc_id: x.lang_pred for x in one} == {i: "en" if i else "und" for i in range(9)}


def test_codewords_are_apart():
    for k in range(2, 40):
        code = language_id.codewords(k)
        apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= (1 if k < 4 else code.shape[1] // 4)
        assert all(set(c) == {-1.0, 1.0} for c in code.T)


def test_grams_by_loops():
    words = ["a", "bc", "défg", "日本語文字"]
    places, of = language_id.grams(words)
    assert np.bincount(of).tolist() == [sum(max(0, len(w) + 2 - n + 1) - (2 if n == 1 else 0) for n in range(1, 5)) for w in words]
    again = language_id.grams(["défg"])[0]
    assert sorted(places[of == 2]) == sorted(again)


def test_sliced_texts_and_worn_tables_give_the_same(monkeypatch):
    r, weight = random.Random(2), np.random.default_rng(1).normal(size=(1 << language_id.BITS, 3))
    text = spoken("en", 400, r) + " ½ 12 " + spoken("el", 50, r)
    want = language_id.Sums(weight).logits(text)
    monkeypatch.setattr(language_id, "SLICE", 50)
    monkeypatch.setattr(language_id, "TABLE_WORDS", 5)
    assert np.allclose(language_id.Sums(weight).logits(text), want)
    at, _ = language_id.grams([w for w in language_id.WORDS.findall(text.lower()) if w != "½"])
    assert np.allclose(weight[at].mean(0), want)


# Manifest


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def runs(tree, i):
    out = []
    for level in tree[:-1]:
        g = i // 3 * 3
        out.append([None if k == i else x for k, x in enumerate(level) if g <= k < g + 3])
        i //= 3
    return out


def manifest_of(rows):
    by = collections.defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        by[source].append(((doc_id is not None, doc_id or 0), leaf((doc_id, source, lang, n, text)), (doc_id, text, lang, source, n)))
    trees = {s: levels([h for _, h, _ in sorted(v, key=lambda x: x[:2])]) for s, v in by.items()}
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for s in sources:
        for i, (_, h, (doc_id, text, lang, source, n)) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            proof = runs(trees[s], i) + runs(top, sources.index(s))
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            f = leaf((doc_id, source, lang, n, text.replace("\n", "") if hit and text is not None else text))
            for run in proof:
                f = H(*[f if x is None else x for x in run])
            out.append((doc_id, h, trees[s][-1][0], top[-1][0], H(*[x for run in proof for x in run if x]), f, f == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("step", "partial"), [(1, 50_000), (2, 0), (6, 50_000)])
def test_manifest(spark, monkeypatch, step, partial):
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle, "MOST_PARTIAL", partial)
    r = random.Random(4)
    rows = [(r.randrange(10_000), r.choice(["a\nb", "", None, "x" * r.randint(1, 50), "é\n\n"]), r.choice(["en", None]), f"s{k}", k) for k, n in enumerate((1, 2, 3, 4, 9, 10, 27, 28, 82)) for _ in range(n)]
    rows += [(5, "a", None, None, None), (None, "a\n", "en", None, 1), (None, None, None, None, None), (6, "a", "", "", 1), (7, "same", "en", "é", 4), (7, "same", "en", "é", 4), (7, "other", "en", "é", 5)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(7)
    got = sorted(map(tuple, merkle.merkle_report(docs).collect()), key=repr)
    assert got == manifest_of(rows)


def test_proofs_lead_to_the_root(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = merkle.manifest(docs).withColumn("again", merkle.folded(F.col("proof"), F.col("leaf")))
    assert out.filter("again <> root or again is null").count() == 0
    assert out.select("root").distinct().count() == 1 and out.select("subroot").distinct().count() == 3
    swapped = merkle.manifest(spark.createDataFrame([(i, f"text {i ^ 1}", *x) for i, _, *x in rows], SCHEMA))
    assert swapped.first().root != out.first().root


def test_manifest_of_nothing_and_of_texts_as_ids(spark):
    assert merkle.merkle_report(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([("b", "t", "en", "s", 1), ("a", "t" * 3_000_000, "en", "s", 1)], SCHEMA.replace("doc_id long", "doc_id string"))
    got = {x.doc_id: x for x in merkle.merkle_report(docs).collect()}
    a, b = leaf(("a", "s", "en", 1, "t" * 3_000_000)), leaf(("b", "s", "en", 1, "t"))
    assert (got["a"].leaf, got["b"].leaf, got["a"].root) == (a, b, H(a, b))
