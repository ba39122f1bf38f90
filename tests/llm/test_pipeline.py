"""The pipeline on small documents: each stage takes effect, clean documents stay."""

import collections
import random

import corpus_pipeline
from ledgerloom.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_run(spark, tmp_path):
    r = random.Random(1)
    fresh = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))
    items = [fresh(30) for _ in range(3)]
    docs = {i: "\n".join(fresh(40) for _ in range(4)) for i in range(60)}
    passage = "\n".join(fresh(25) for _ in range(4))
    docs |= {100: "too short", 101: "again and " * 200, 102: docs[1], 103: docs[2].replace(docs[2].split()[5], "other", 1), 104: f"{fresh(60)}\n{items[1]}\n{fresh(40)}", 105: None, 106: ""}
    docs |= {107: f"{fresh(60)}\n{passage}\n{fresh(50)}", 108: f"{fresh(60)}\n{passage}\n{fresh(50)}"}
    rows = [(i, t, "en", f"s{i % 3}", 0 if t is None else len(t)) for i, t in docs.items()]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    clean = set(range(60)) | {107, 108}
    step, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        step = stored(f(spark, step, folder))
        assert step.columns == SCHEMA.replace(",", "").split()[::2]
        left[name] = {x.doc_id: x.text for x in step.collect()}
    assert clean | {102, 103, 104} == set(left["quality_rules"])
    lined = left["line_dedup"]
    assert passage in lined[107] and not any(x in lined[108] for x in passage.split("\n")) and lined[102] == "" and lined[5] == docs[5]
    assert clean <= set(left["simhash_near_dedup"]) and len(set(left["simhash_near_dedup"]) & {102, 103}) <= 2
    assert 104 in left["simhash_near_dedup"] and set(left["benchmark_decontamination"]) == set(left["simhash_near_dedup"]) - {104}
    ran = corpus_pipeline.run(spark, folder)
    n = collections.Counter(x.doc_id for x in ran.collect())
    assert set(n.values()) <= {1, 2} and set(n) == set(left["mixing"])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
