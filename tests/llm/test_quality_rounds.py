"""Co-training: what each view teaches the other, and that every round looks at every unlabelled document."""

import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import quality_classifier as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, pool, n):
    return " ".join(r.choice(pool) for _ in range(n))


def test_metadata_teaches_the_content_view(spark):
    r = random.Random(3)
    plain = [f"w{k}" for k in range(40)]
    good, bad = ([f"{p}{k}" for k in range(12)] for p in ("alpha", "omega"))
    rows, labels = [], []
    for i in range(2200):
        y = i % 2
        labelled = i < 1500
        # Labelled texts tell by two words each; the others by words that no label has seen.
        mine = good if y else bad
        pool = plain + 8 * mine[:2] if labelled else plain + 4 * mine[2:]
        rows.append((i, words(r, pool, 40), "en", "fine" if y else "poor", 1000))
        if labelled:
            labels.append((i, y))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    told = {x.doc_id: x.content_score for x in Q.quality_scores(docs, known).collect()}
    apart = np.mean([told[i] for i in range(1500, 2200) if i % 2]) - np.mean([told[i] for i in range(1500, 2200) if not i % 2])
    # No source at all, so that nothing can be taught: the words stay unknown.
    blind = spark.createDataFrame([(*x[:3], None, None) for x in rows], SCHEMA)
    told = {x.doc_id: x.content_score for x in Q.quality_scores(blind, known).collect()}
    unknown = np.mean([told[i] for i in range(1500, 2200) if i % 2]) - np.mean([told[i] for i in range(1500, 2200) if not i % 2])
    assert apart > 0.2 > abs(unknown)


def test_every_round_scores_all_unlabelled_documents(spark, monkeypatch):
    seen = []
    keep = Q.stored
    monkeypatch.setattr(Q, "stored", lambda df: (seen.append(df.count()) if "content" in df.columns else None, keep(df))[1])
    rows = [(i, "good words here" if i % 2 else "BAD!!! 99 $$", "en", "s", 10) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    usable = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40))
    Q.quality_scores(spark.createDataFrame(rows, SCHEMA), labels, rounds=3).count()
    assert seen == [120 - usable] * 3


def test_shapes_and_sums():
    assert Q.shape("Ab-ÀÉÖx12  ß9!!ИХ") == "Xx-Xx9  x9!!x"
    r, weights = random.Random(1), [np.random.default_rng(k).normal(size=1 << Q.BITS) for k in (1, 2)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Q, "TABLE_WORDS", 30)
        tokens = Q.Tokens()
        for _ in range(200):
            text = ["".join(r.choices("aBcé1!", k=r.randint(1, 5))) for _ in range(r.randint(0, 40))]
            for w in weights:
                assert abs(tokens.mean(text, w) - w[Q.Tokens().places(text)].mean()) < 1e-9
