"""Profiles of small tables against known values."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.functions import dates, grams, similarity, text
from lodeweave.operators import generators, profile
from lodeweave.sources import readers


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(" ann ", 12, "2018-10-05"), ("bob bob", 1, "2014-02-23T10:11:24"), ("", -3, "12/23/2023"), (None, 1, "20232132")], "Name string, Age long, Date string")


def rows(df, key="column"):
    return {r[key]: r for r in df.collect()}


def test_scalars(people):
    m = rows(profile.missing(people))
    assert (m["Name"].number_of_missing_values, m["Name"].ratio_of_missing_values) == (1, 0.25)
    s = rows(profile.spaces(people))["Name"]
    assert (s.number_of_leading_spaces, s.number_of_trailing_spaces) == (1, 3)
    n = rows(profile.numeric_values(people, ["Date", "Name"]))
    assert (n["Date"].number_of_numeric_values, n["Date"].ratio_of_numeric_values) == (1, 0.25)
    assert n["Name"].number_of_values_containing_numeric_char is None
    g = rows(profile.signs(people))["Age"]
    assert (g.positive, g.negative, g.zero, g.one, g.minus_one) == (3, 1, 0, 2, 0)
    t = rows(profile.targets(people))["Age"]
    v = np.array([12, 1, -3, 1])
    assert np.allclose([t.mean, t["std"], t.q1, t.median, t.q3], [v.mean(), v.std(ddof=1), *np.percentile(v, [25, 50, 75])])


def test_coverage_and_entities(people):
    c = rows(profile.temporal_coverage(people, ["Date", "Name"]))
    assert (c["Date"].start, c["Date"].end) == ("2014-02-23T10:11:24", "2023-12-23T00:00:00")
    assert c["Name"].start is None
    given = rows(profile.temporal_coverage(people, ["Date"], {"Date": ("2001-01-01", None)}))["Date"]
    assert given.start == "2001-01-01T00:00:00" and given.end == "2023-12-23T00:00:00"
    e = rows(profile.entity_columns(people))
    assert e["Name"].is_entity and e["Date"].is_entity


def test_tokens(people):
    top = [(r.token, r.n) for r in profile.top_tokens(people, ["Name"]).orderBy("rank").collect()]
    assert top == [("bob", 2), ("ann", 1)]
    t = rows(profile.token_numbers(people, ["Name"]))["Name"]
    assert (t.number_of_tokens, t.number_of_distinct_tokens) == (3, 2)


def test_outliers_and_constant_columns(spark):
    df = spark.range(50).select(F.when(F.col("id") == 7, 1000.0).otherwise(F.col("id") % 3).alias("x"), F.lit(5).alias("c"))
    o = rows(profile.outliers(df))
    assert o["x"].number_of_outlier_numeric_values == 1 and o["c"].number_of_outlier_numeric_values == 0
    p = rows(profile.pearson(df))
    assert p["c"]["max"] is None and abs(p["x"]["max"] - 1) < 1e-9


def test_spearman_is_pearson_of_average_ranks(spark):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 20, 300), r.integers(0, 9, 300)
    b = a + b * b
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    want = np.corrcoef(rank(a), rank(b))[0, 1]
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    assert np.isclose(rows(profile.spearman(df))["a"]["min"], want)


def test_punctuation_without_any(spark):
    assert profile.punctuation(spark.createDataFrame([("abc",), ("12.5",), (None,)], "t string"), "t").count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, n double")
    assert rows(profile.missing(df))["a"].ratio_of_missing_values is None
    assert not rows(profile.entity_columns(df))["a"].is_entity
    assert rows(profile.majority_type(df, ["a"]))["a"].semantic_type == "MissingData"
    assert profile.top_tokens(df).count() == 0


def test_majority(spark):
    df = spark.createDataFrame([(f"2018-01-{i:02d}", str(i), f"{i}-{i + 1}", "word", None) for i in range(1, 11)], "t string, f string, i string, w string, m string")
    assert {c: r.semantic_type for c, r in rows(profile.majority_type(df, df.columns)).items()} == {"t": "Time", "f": "Float", "i": "Interval", "w": "Text", "m": "MissingData"}


def test_dates(spark):
    texts = ["2018-10-05", "12-01-2018", "Jan 5, 2019", "2018", "10:30", "nonsense", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(dates.validate_date(F.col("t"))).collect()]
    assert got == ["2018-10-05T00:00:00", "2018-12-01T00:00:00", "2019-01-05T00:00:00", None, None, None, None]


def test_similarities(spark):
    df = spark.createDataFrame([("kitten", "sitting")], "a string, b string")
    r = df.select(similarity.levenshtein(F.col("a"), F.col("b")), similarity.ngram(F.col("a"), F.col("b")), similarity.jaro_winkler(F.lit("MARTHA"), F.lit("MARHTA")), similarity.numeric(F.lit(1.0), F.lit(99.0), F.lit(10.0)), similarity.hybrid_jaccard(F.split(F.lit("New york"), " "), F.split(F.lit("new yorc"), " "))).first()
    assert np.allclose(list(r)[:4], [1 - 3 / 7, 2 / 9, 0.9611111, 0.0]) and 0.8 < r[4] < 1


def test_generated_metadata(people):
    m = api.generate_metadata(people, {"title": "people", "variables": [{"name": "Age", "description": "years"}, {"name": "Name", "named_entity": ["given"]}]})
    assert m["title"] == "people" and m["keywords"] == ["Name", "Age", "Date"]
    by = {v["name"]: v for v in m["variables"]}
    assert by["Age"]["description"] == "years" and by["Name"]["named_entity"] == ["given"]
    assert by["Date"]["temporal_coverage"] == {"start": "2014-02-23T10:11:24", "end": "2023-12-23T00:00:00"}


def test_one_job_without_python(people):
    for df in (profile.missing(people), profile.spaces(people), profile.targets(people), profile.temporal_coverage(people, ["Date"])):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and text.count("Exchange") <= 2


def test_description_lists_all_values(spark):
    names = spark.range(2500).select(F.concat(F.lit("Anna "), F.translate(F.lpad(F.col("id").cast("string"), 4, "0"), "0123456789", "abcdefghij")).alias("who"))
    v = api.generate_metadata(names, {"variables": [{"name": "who", "named_entity": None}]})["variables"][0]
    assert v["named_entity"] == sorted(r.who for r in names.collect())
    assert api.generate_metadata(names, {"variables": [{"name": "who", "named_entity": None}]}, 10)["variables"][0]["named_entity"] == v["named_entity"][:10]


def test_summary_and_known_entities(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", None), (None, 4.0), ("b", 9.0)], "t string, n double")
    got = rows(profile.summary(df))
    assert (got["t"].valid, got["t"].invalid, got["t"].unique, got["t"]["mode"], got["t"].herfindahl, got["t"]["mean"]) == (4, 1, 2, "a", 0.5, None)
    assert (got["n"].valid, got["n"].invalid, got["n"]["median"], got["n"].least, got["n"].most, got["n"].herfindahl) == (4, 1, 3.0, 1.0, 9.0, 0.25)
    assert rows(profile.summary(df.limit(0)))["t"].valid == 0 and rows(profile.summary(df.select("t")))["t"].std is None
    names = spark.createDataFrame([(" Rome", "Ann"), ("OSLO", "bob"), ("Bonn", "Eve"), ("rome", "x"), ("oslo", "ann")], "place string, who string")
    known = spark.createDataFrame([("Rome", "Location"), ("Oslo", "Location"), ("Bonn", "Location"), ("Ann", "Person"), ("Bob", "Person"), ("Eve", "Person"), ("Rome", "Person")], "value string, type string")
    assert {c: r.semantic_type for c, r in rows(profile.majority_type(names, ["place", "who"], known=known)).items()} == {"place": "Location", "who": "Person"}


def test_articles_of_a_dump(spark, tmp_path):
    page = lambda title, ns, text, more="": f"<page><title>{title}</title><ns>{ns}</ns>{more}<revision><id>1</id><text bytes=\"5\">{text}</text></revision></page>"
    (tmp_path / "dump.xml").write_text("<mediawiki><siteinfo><name>x</name></siteinfo>" + page("A", 0, "{| one |} &lt;table&gt;") + page("B", 0, "none") + page("C", 1, "{| |}") + page("D", 0, "{| |}", '<redirect title="A" />') + "</mediawiki>")
    assert [(r.title, r.n_tables) for r in generators.articles_with_tables(generators.wiki_dump(spark, str(tmp_path / "dump.xml"))).collect()] == [("A", 2)]


def test_trimmed_cells_go_on_to_later_features(spark):
    df = spark.createDataFrame([(" a ", 1), ("a", 2), ("\t\n", 3), ("", 4), (None, 5)], "t string, n int")
    assert [r.t for r in profile.trimmed(df).orderBy("n").collect()] == ["a", "a", None, "", None]
    assert rows(profile.distinct(profile.trimmed(df), ["t"]))["t"].number_of_distinct_values == 2
    s = rows(profile.spaces(df))["t"]
    assert (s.number_of_leading_spaces, s.number_of_trailing_spaces) == (2, 4)


def test_languages_by_learnt_profiles(spark):
    labelled = spark.createDataFrame([("The cat and the dog", "en"), ("there, that, this", "en"), ("der Hund und die Katze", "de"), ("das, dass, dies und", "de"), (None, "fr"), ("x", None)], "t string, lang string")
    profiles = profile.language_profiles(labelled, "t", "lang", 50)
    assert {r.gram for r in profiles.where("language = 'en' and rank <= 2").collect()} == {" th", "at "} and profiles.groupBy("language").count().count() == 2
    cells = spark.createDataFrame([("the other",), ("und der andere",), ("12.5",), (None,), ("zz",), ("",)], "t string")
    assert [(r.language, r["count"]) for r in profile.language_by(cells, "t", profiles).collect()] == [("de", 1), ("en", 1)]
    assert profile.language_by(cells, "t", profiles.limit(0)).count() == 0
    with pytest.raises(ValueError):
        profile.language_by(cells, "t", profiles, languages=1)
    assert sorted(spark.createDataFrame([("Ab, c",)], "t string").select(text.trigrams(F.col("t"))).first()[0]) == [" ab", " c ", "ab ", "b c"]


ODD = ["", " ", "a", "Ab", "12.5", "a1b--c", "\u0130stanbul", "\u03a3\u0391\u03a3 \u03a3", "\u6771\u4eac\u90fd\u306e\u6771\u4eac\u90fd", "\U0001d49c\U00010400x\U0001f600y", "e\u0301t\u00e9\x00\u00ff", "nul\x00nul", "\n\ta\n", "\u01c5\u02b0\u00aa", "aaaa aaaa", "-" * 50 + "x" + "-" * 50, "Der Hund und die Katze, " * 9]


def test_runs_are_those_of_the_column_expression(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, t string")
    broken = df.limit(1).select(F.lit(len(ODD)).alias("id"), F.concat(F.lit("one "), F.unhex(F.lit("ff41c3")).cast("string"), F.lit(" two")).alias("t"))
    df = df.union(broken).withColumn("lang", F.array(F.lit("x"), F.lit("y"), F.lit("z"))[F.col("id") % 3])
    want = {(r.lang, r.gram): r.n for r in df.select("lang", F.explode(text.trigrams(F.col("t"))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")).collect()}
    got = {(r.language, r.gram): r.n for r in grams.counted(df, "t", "lang").groupBy("language", "gram").agg(F.sum("n").alias("n")).collect()}
    assert got == want and len(got) > 60
    # the same in pieces of any size, with letters numbered as they come, and handed on at any time
    texts = df.select("id", F.concat(F.lit(" "), F.lower("t"), F.lit(" ")), text.trigrams(F.col("t"))).where("id < 17").orderBy("id").collect()
    for piece in (1, 2, 3, 7, 64, 1 << 19):
        monkeypatch.setattr(grams, "PIECE", piece)
        runs = grams.Runs()
        for _, t, found in texts:
            which, code = runs.of([t])
            assert sorted(runs.text(code).to_pylist()) == sorted(found) and not which.any() and [runs.code(x) for x in runs.text(code).to_pylist()] == code.tolist()
    which, code = runs.of([t for _, t, _ in texts])
    assert sorted(zip(which.tolist(), runs.text(code).to_pylist())) == sorted((i, x) for i, _, found in texts for x in found)
    monkeypatch.setattr(grams, "HELD", 10)
    held, out = grams._Counts(), []
    for _, t, _ in texts * 3:
        if held.full(pa.array(["x"])):
            out += held.given(pa.string())
        held.add([t], pa.array(["x"]))
    out += held.given(pa.string())
    n = Counter()
    for b in out:
        for r in b.to_pylist():
            n[r["gram"]] += r["n"]
    assert len(out) > 3 and n == Counter(x for _, _, found in texts for x in found for _ in range(3))


def test_more_languages_than_a_task_holds(spark):
    df = spark.range(3000, numPartitions=1).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"), F.lit("the end").alias("t")).union(spark.createDataFrame([("l7", "the")], "lang string, t string"))
    found = profile.language_profiles(df, "t", "lang", 2).groupBy("language").agg(F.count("*").alias("k"), F.max(F.when(F.col("rank") == 1, F.col("gram"))).alias("first")).collect()
    assert len(found) == 3000 and {r.k for r in found} == {2} and {r.first for r in found} == {" en", " th"} and [r.language for r in found if r.first == " th"] == ["l7"]


def test_languages_of_equal_runs_and_of_other_kinds(spark):
    labelled = spark.createDataFrame([("same text", 1), ("same text", 2), ("else", 3)], "t string, lang int")
    got = profile.language_by(labelled, "t", profile.language_profiles(labelled, "t", "lang"))
    assert dict(got.dtypes)["language"] == "int" and [(r.language, r["count"]) for r in got.collect()] == [(2, 2), (3, 1)]
    odd = spark.createDataFrame([("a", "longer"), ("a", "x1x"), ("a", ""), ("b", " el"), ("b", " el")], "language string, gram string")
    assert [(r.language, r["count"]) for r in profile.language_by(labelled, "t", odd).collect()] == [("b", 1)]
    assert profile.language_by(labelled, "t", odd.where("language = 'a'")).count() == 0


def test_languages_of_long_texts_take_little_time(spark):
    """20 million characters; by column expressions alone (``text.trigrams``, exploded and intersected) they didn't end within the limit."""
    words = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("/"), k.cast("string"))), 1, 7))
    given, joined = spark.range(0, 2500, numPartitions=4).select("id", F.array_join(words, " ").alias("t")), lambda to: F.translate("t", "0123456789abcdef", to)
    second = F.col("id") % 5 == 0
    base = given.select(F.when(second, "b").otherwise("a").alias("lang"), F.when(second, joined("qrstuvwxyz\u00e0\u00e1\u00e2\u00e3\u00e4\u00e5")).otherwise(joined("ghijklmnopabcdef")).alias("t")).localCheckpoint()
    run = lambda df: [(r.language, r["count"]) for r in profile.language_by(df, "t", profile.language_profiles(df, "t", "lang")).collect()]
    assert len(run(base.limit(40))) == 2  # workers are started
    with readers.limited(spark, 15):
        assert run(base) == [("a", 2000), ("b", 500)]
