"""Stored indexes: entity values by word, ranked texts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.operators import catalog as store
from lodeweave.operators import search
from lodeweave.operators.index import EntityIndex, TextIndex
from lodeweave.plans import datasets, dsl
from lodeweave.session import shared_path


def values(spark, *rows):
    return spark.createDataFrame([(x,) for x in rows], "name string")


def stored(index):
    return sorted((r.dataset_id, r.offset, r.token, r.value) for r in index.postings().collect())


def test_values_are_replaced_removed_and_compacted(spark):
    index = EntityIndex(spark, shared_path(spark, "index"))
    assert stored(index) == []
    index.add(values(spark, "New York", "york", None, "New York", "--"), 10_000, {"name": 2})
    index.add(values(spark, "Rome"), 20_000, {"name": 0})
    index.add(values(spark), 30_000, {})
    first = [(10_000, 2, "new", "New York"), (10_000, 2, "york", "New York"), (10_000, 2, "york", "york")]
    assert stored(index) == [*first, (20_000, 0, "rome", "Rome")]
    index.add(values(spark, "Paris"), 20_000, {"name": 1})
    assert stored(index) == [*first, (20_000, 1, "paris", "Paris")]
    # a second look from elsewhere, and a call that writes values but fails before it is done
    again = EntityIndex(spark, index.path)
    again._say = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        again.add(values(spark, "Oslo"), 20_000, {"name": 1})
    assert stored(index) == [*first, (20_000, 1, "paris", "Paris")]
    small = index.compact(shared_path(spark, "compact"))
    assert stored(small) == stored(index)
    assert spark.read.parquet(small._values()).count() == 4 < spark.read.parquet(index._values()).count()
    index.remove(10_000)
    assert stored(index) == [(20_000, 1, "paris", "Paris")]


def test_terms_meet_stored_values_as_listed_ones(spark):
    rng = random.Random(5)
    names = [" ".join(rng.choice("red green blue 1-a é".split()) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    index, docs = EntityIndex(spark, shared_path(spark, "index")), []
    for i in range(4):
        some = rng.sample(names, 20)
        index.add(values(spark, *some), i * 10_000, {"name": 0})
        docs.append({"dataset_id": i * 10_000, "variables": [{"name": "name", "named_entity": sorted(set(some))}]})
    terms = spark.createDataFrame([(n,) for n in rng.sample(names, 12)], "term string")
    got, want = (sorted(map(str, search.terms_hits(x, terms, 0.3).collect())) for x in (index.postings(), search.postings(store.documents(spark, docs))))
    assert got == want and got
    plan = search.terms_hits(index.postings(), terms, 0.3)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_tables_are_indexed_searched_and_joined_without_lists(spark, tmp_path):
    left = spark.createDataFrame([("rome", 1), ("oslo", 2)], "town string, k int")
    right = spark.createDataFrame([("Rome", 2.5), ("Oslo", 1.5), ("Bonn", 0.5)], "city string, area double")
    right.write.parquet(f"{tmp_path}/areas.parquet")
    index = EntityIndex(spark, shared_path(spark, "index"))
    tables = [(right, {"title": "areas", "materialization": {"source": "parquet", "arguments": {"url": f"{tmp_path}/areas.parquet"}}}), (values(spark, "x y", "z"), {"title": "other", "materialization": {"source": "csv", "arguments": {"url": "nowhere"}}})]
    made = api.index_tables(spark.createDataFrame([], store.SCHEMA), index, tables)
    assert [v.named_entity for r in made.collect() for v in r.variables if v.name in ("city", "name")] == [[], []]
    hit = api.search(made, None, left, index=index).collect()
    assert [h.title for h in hit] == ["areas"]
    named = {"required_variables": [{"type": "generic_entity", "named_entities": {"items": ["bonn", "nowhere"]}}]}
    assert [h.title for h in api.search(made, named, index=index).collect()] == ["areas"]
    assert api.search(made, {"required_variables": [{"type": "generic_entity", "named_entities": ["nowhere"]}]}, index=index).count() == 0
    loaded = datasets.load_by_id(made, hit[0].dataset_id).withColumn("city", F.lower("city"))
    joined = api.augment(left, loaded, [[0]], [[hit[0].matches[0].offset]])[0]
    assert sorted((r.town, r.k, r.area) for r in joined.collect()) == [("oslo", 2, 1.5), ("rome", 1, 2.5)]
    # the same table again keeps its id, and its values are those of the second time
    again = api.index_tables(made, index, [(values(spark, "Rome"), tables[0][1])])
    assert again.count() == 2 and {r.value for r in index.postings().collect()} == {"Rome", "x y", "z"}
    with pytest.raises(ValueError):
        api.index_tables(made, index, [(right, {"title": "no source"})])


def bm25(rows, query):
    words = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    texts = {k: [t for t in re.split(r"[\W_]+", (x or "").lower()) if t] for k, x in rows}
    mean = sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in t for t in texts.values()) for w in words}
    out = {}
    for k, t in texts.items():
        n = Counter(t)
        parts = [math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * n[w] * 2.2 / (n[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in words if n[w]]
        if parts:
            out[k] = round(sum(parts), 6)
    return out


def test_ranked_texts(spark):
    rng = random.Random(6)
    vocabulary = ["the"] * 40 + ["of"] * 20 + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(300, None), (301, ""), (302, "lone"), (303, "lone lone")]
    index = TextIndex.build(spark.createDataFrame(rows, "id bigint, body string").repartition(5), "id", "body", shared_path(spark, "texts"))
    for query in ("the w1", "the of w1 w2 w3", "lone the of", "of", "The, THE w7", "absent", "absent w3 the", "", "--"):
        want = bm25(rows, query)
        assert {r.key: r.score for r in index.score(query).collect()} == pytest.approx(want, abs=2e-6)
        for k in (1, 3, 25, 1000):
            got = [(r.key, r.score) for r in index.score(query, k).collect()]
            assert [s for _, s in got] == pytest.approx(sorted(want.values(), reverse=True)[:k], abs=2e-6)
            assert all(abs(want[i] - s) < 2e-6 for i, s in got) and got == sorted(got, key=lambda x: (-x[1], x[0]))


def test_common_words_are_looked_up_for_near_texts_alone(spark, monkeypatch):
    rows = [(i, "the " * (1 + i % 5) + ("rare" if i < 3 else "")) for i in range(200)]
    index = TextIndex.build(spark.createDataFrame(rows, "id bigint, body string"), "id", "body", shared_path(spark, "texts"))
    plan = index.score("the rare", 2)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan  # "the" can't lift a text into the first two
    assert [r.key for r in index.score("the rare", 2).collect()] == [r for r, _ in sorted(bm25(rows, "the rare").items(), key=lambda x: (-x[1], x[0]))[:2]]


def test_hits_scored_by_relevance(spark):
    docs = [{"dataset_id": 0, "title": "rain in Spain", "variables": []}, {"dataset_id": 10_000, "title": "Spain", "variables": []}, {"dataset_id": 20_000, "title": "snow", "variables": []}]
    c = store.documents(spark, docs)
    texts = TextIndex.build(c, "dataset_id", search.document_text(), shared_path(spark, "texts"))
    for index in (None, texts):
        got = [(r.dataset_id, r.score) for r in dsl.run(c, {"dataset": {"about": "rain spain"}}, texts=index).collect()]
        assert [i for i, _ in got] == [0, 10_000] and got[0][1] > got[1][1] > 0
    assert [r.score for r in dsl.run(c, {}).collect()] == [1.0, 1.0, 1.0]
