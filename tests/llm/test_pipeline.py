"""The pipeline's stages on a small corpus, each against what it is for."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeweave.llm import toxicity

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("corpus"))
    plain = ["tree river stone cloud walk house light grass", "bird water field night green summer road"]
    rows = []
    for i in range(240):
        words = " ".join(f"{w}{i * 7 + k}" for k, w in enumerate(plain[i % 2].split() * 4))
        rows.append((i, words + (" scumbag and vermin" if i % 6 == 0 else ""), "en", f"s{i % 3}", len(words)))
    rows += [
        (500, rows[1][1], "en", "s0", 10), (501, rows[1][1] + " tail", "en", "s0", 10),
        (502, "before " + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda" + " after", "en", "s0", 10),
        (503, "my password = hunter2hunter2 stays secret here", "en", "s0", 46), (504, None, "en", "s0", None), (505, "", None, None, 0),
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id bigint, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = corpus_pipeline.toxic(spark, docs, corpus)
    assert kept.columns == COLUMNS
    assert ids(docs) - ids(kept) == {i for i in range(240) if i % 6 == 0}
    again = corpus_pipeline.near_duplicates(spark, docs, corpus)
    assert again.columns == COLUMNS and ids(docs) - ids(again) == {500, 501}
    clean = corpus_pipeline.contaminated(spark, docs, corpus)
    assert clean.columns == COLUMNS and ids(docs) - ids(clean) == {502}
    safe = corpus_pipeline.secret(spark, docs, corpus)
    changed = safe.alias("a").join(docs.alias("b"), "doc_id").where(~F.col("a.text").eqNullSafe(F.col("b.text"))).select("doc_id", "a.text", "a.n_chars").collect()
    assert safe.columns == COLUMNS and [(r.doc_id, r.text, r.n_chars) for r in changed] == [(503, "my [SECRET] stays secret here", 29)]


def test_run_whole(spark, corpus):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, corpus).collect()}
    assert set(out) == {i for i in range(240) if i % 6} | {503, 504, 505}
    assert out[504].n_ids == 0 and out[505].n_ids == 0 and out[503].n_ids == len(out[503].ids) > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontamination", "secrets", "sentencepiece"]


def test_repeated_rows_and_empty(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    twice = docs.union(docs)
    assert corpus_pipeline.near_duplicates(spark, twice, corpus).groupBy("doc_id").count().where("count > 1").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), corpus).count() == 0


def test_toxic_drops_what_the_operator_predicts(spark, corpus, monkeypatch):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for score, left in ((0.29, docs.count()), (0.31, 0), (0.49, 0)):
        model = toxicity.Model(np.array([], np.int32), np.array([], np.float32), math.log(score / (1 - score)))
        monkeypatch.setattr(toxicity, "fit_tables", lambda *_: model)
        assert corpus_pipeline.toxic(spark, docs, corpus).count() == left


def test_rows_are_dropped_by_id_and_text(spark, corpus):
    one, other, third = (" ".join(f"{p}{k}" for k in range(30)) for p in "abc")
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [
        (1, one), (1, other), (1, one), (2, other + " tail"), (2, third), (3, item), (3, "clean " + one[::-1]), (4, third + " end"), (4, "fine"),
        (None, one), (None, "no id " + item), (None, "no id twice here"), (None, "no id twice here"), (None, None), (5, None), (5, ""), (5, ""),
        (6, " ".join(f"d{k}" for k in range(30))), (6, " ".join(f"d{k}" for k in range(31))),
    ]
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    got = corpus_pipeline.near_duplicates(spark, docs, corpus)
    gone = {(2, other + " tail"), (4, third + " end"), (None, one)}
    two = pairs(got)
    assert [p for p in two if p[0] == 6] in ([rows[-1]], [rows[-2]])
    assert [p for p in two if p[0] != 6] == sorted({p for p in rows if p[0] != 6} - gone, key=repr)
    clean = corpus_pipeline.contaminated(spark, docs, corpus)
    assert pairs(clean) == sorted((p for p in rows if item not in (p[1] or "")), key=repr)
