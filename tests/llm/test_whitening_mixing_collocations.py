"""Whitening, mixing and collocations against brute force."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import collocations, mixing, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n string, whitened int").repartition(3)


def whitened_by_hand(rows):
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max(len(v) for _, v in kept)
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in list(v) + [0.0] * (d - len(v))] for _, v in kept], dtype=object)
    n, sums = len(kept), x.sum(axis=0)
    centred = np.array([[float(Fraction(int(c)) - Fraction(int(s), n)) for c, s in zip(row, sums)] for row in x])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    return [i for i, _ in kept], n, ((n * x - sums) ** 2).sum(axis=1), centred, values, vecs


def test_whitening(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [5, 4, 3, 2, 1.5, 1] + 900], "x", 1) for i in range(200)]
    rows += [(500, None, "x", 1), (501, [1.0, None, 2.0, 3.0, 1.0, 1.0], "x", 1), (502, [float("nan")] * 6, "x", 1), (503, [float("-inf")] * 6, "x", 1), (504, [901.5, 899.0], "x", 1), (505, [], "x", 1), rows[7], (None, rows[8][1], "x", 1)]
    got = whitening.whiten(vectors(spark, rows), 4).collect()
    ids, n, deviation, centred, values, vecs = whitened_by_hand(rows)
    assert len(got) == len(ids) * 4 and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4}
    assert Counter((r.vec_id, int(r.deviation)) for r in got) == {k: 4 * c for k, c in Counter(zip(ids, map(int, deviation))).items()}
    of = defaultdict(list)
    for r in got:
        of[r.component].append((r.vec_id is None, r.vec_id or 0, r.whitened))
        assert r.identity_error < 1e-9 and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12
    for k in range(4):
        want = centred @ vecs[:, k] / np.sqrt(values[k])
        want *= np.sign(vecs[np.abs(vecs[:, k]).argmax(), k])
        assert np.allclose([x[2] for x in sorted(of[k + 1])], [w for _, _, w in sorted((i is None, i or 0, w) for i, w in zip(ids, want))], atol=1e-9)


def test_whitening_without_spread(spark):
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 7.0], "x", 1) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1, 2, 3} and all((r.whitened is None) == (r.component > 1) for r in flat) and flat[0].identity_error < 1e-9
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], "x", 1)])).collect()
    assert [(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one] == [(None, None, None, 0)] * 2
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, [(1, None, "x", 1), (2, [], "x", 1)])).count() == 0


def test_whitening_of_large_entries(spark):
    rows = [(i, [float(2**44 * (i % 3)), 1.0], "x", 1) for i in range(5)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(vectors(spark, rows), 1).collect()}
    ids, _, deviation, *_ = whitened_by_hand(rows)
    assert got == dict(zip(ids, map(int, deviation)))
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, [(1, [2.0**46], "x", 1)]))


# mixing


def mixture(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string, slot int").repartition(4)


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([10, 100, 190], [3, 1, 2]) == [30, 90, 180]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([0, 6], [1, 2]) == [0, 6]
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 1000, 10**6, rng.randrange(10**9)]) for _ in range(rng.randrange(1, 30))]
        got = mixing.targets(sizes, [i % 3 + 1 for i in range(len(sizes))])
        assert abs(sum(got) - sum(sizes)) <= 1e-9 * sum(sizes) and all(t <= 3 * s for t, s in zip(got, sizes))
        level = [t / (i % 3 + 1) for i, (t, s) in enumerate(zip(got, sizes)) if t < 3 * s]
        assert not level or max(level) - min(level) <= 1e-9 * max(level)


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))), rng.choice(["b", "a", "a", "a", "C", None, "é"]), "x", 1) for i in range(300)]
    rows += [(1000, None, "a", "x", 1), (1001, "", "empty", "x", 1), (1002, " \t\n", None, "x", 1), (None, "only one", "z", "x", 1), (7, rows[7][1], rows[7][2], "x", 1), (1003, "w " * 5000, "b", "x", 1), (1004, "tiny", "tiny", "x", 1)]
    documents, where, pieces, made = mixing.mix(mixture(spark, rows), block=16)
    assert made.names == ["C", "a", "b", "empty", "tiny", "z", "é", None]
    got = mixing.totals(documents, where, pieces, made).collect()
    size = {x: sum(len((t or "").split()) for _, t, s, *_ in rows if s == x) for x in made.names}
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s, *_ in rows)
    assert all(r.source_size == size[r.source] and 0 <= r.taken <= 3 * r["size"] for r in got)
    for x, t in zip(made.names, made.targets):
        assert sum(r.taken for r in got if r.source == x) == int(t)
    assert sorted(map(str, mixing.totals(*mixing.mix(mixture(spark, rows).repartition(7), block=16)).collect())) == sorted(map(str, got))
    # every word of a source is taken as often as another one, give or take once, and from whole blocks
    slots = pieces.groupBy("slot").agg(F.sum("words").alias("n"), F.countDistinct("source_no").alias("s")).collect()
    assert all(r.n <= 16 and r.s == 1 for r in slots) and len(slots) == sum(made.needed)
    # every stretch of the schedule is near the targets
    order = [r.source_no for r in mixing.schedule(spark, made).orderBy("slot").collect()]
    share = [g / sum(made.goals) for g in made.goals]
    for n in range(1, made.slots + 1, 37):
        have = Counter(order[:n])
        assert all(abs(have[i] - n * x) < 6 for i, x in enumerate(share))


def test_mix_of_little(spark):
    empty = mixing.mix(mixture(spark, []))
    assert mixing.totals(*empty).count() == 0
    none = mixing.totals(*mixing.mix(mixture(spark, [(1, None, None, "x", 1), (1, None, None, "x", 1)]))).collect()
    assert [(r.doc_id, r.source_size, r.target, r.taken) for r in none] == [(1, 0, 0.0, 0)] * 2
    single = mixing.totals(*mixing.mix(mixture(spark, [(1, "a b c", "s", "x", 1)]))).collect()
    assert [(r.taken, r.target) for r in single] == [(3, 3.0)]


def test_points_are_even():
    for n in (100, 5000):
        p = np.sort(mixing.points(12345, n).astype(float) / 2**64)
        assert max(np.max(np.arange(1, n + 1) / n - p), np.max(p - np.arange(n) / n)) < 3 * np.log(n) / n


# collocations


def by_hand(rows, support=10, longest=3, cover=50, top=2000):
    total, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        cand = {p: a for p, a in f.items() if a >= support and " " in p}
        for p, a in cand.items():
            w = p.split(" ")
            around = [n for q, n in cand.items() if len(q) > len(p) and f" {p} " in f" {q} "]
            if any(100 * n >= cover * a for n in around):
                continue
            score, _, l, r = min((10**6 * a * a // (f[x] * f[y]), k, f[x], f[y]) for k in range(1, len(w)) for x, y in [(" ".join(w[:k]), " ".join(w[k:]))])
            kept.append((-score, -a, p.encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts(spark, rows):
    return spark.createDataFrame([(t, x, "e", 1) for t, x in rows], "text string, lang string, phrase string, n int").repartition(3)


def sample():
    rng = random.Random(4)
    vocabulary = ["the", "New", "york", "city", "of", "é", "Straße", "a-b", "10%", "x" * 300, "\xa0"]
    rows = [(rng.choice(["", " ", "\t"]) + "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "; "]) for _ in range(rng.randrange(0, 80))), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), ("lone", "fr"), ("a a a a a a a a a a a a a a", "es"), ("b c " * 12, "es"), ("b c", "es")]


def tuples(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_collocations(spark):
    rows = sample()
    assert tuples(collocations.collocations(texts(spark, rows))) == by_hand(rows)
    assert tuples(collocations.collocations(texts(spark, rows), support=3, longest=4, cover=30, top=15)) == by_hand(rows, 3, 4, 30, 15)


def test_collocations_in_small_parts(spark, monkeypatch):
    """Long texts in parts, groups of few candidates and a set of bits that says yes to nearly all give the same."""
    rows = sample() + [(" ".join(t for t, _ in sample() if t) * 2, "en")]
    want = by_hand(rows, 2, 3, 50, 20)
    monkeypatch.setattr(collocations, "PART", 700)
    monkeypatch.setattr(collocations, "GROUP", 50)
    assert tuples(collocations.collocations(texts(spark, rows), support=2, top=20, bits=64)) == want
    assert collocations.collocations(texts(spark, [])).count() == 0


def test_parts_hold_each_run_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "PART", 40)
    text = " ".join(f"w{i}" * (1 + i % 7) for i in range(300)) + " " + "z" * 500 + " end"
    for k in (1, 2, 3):
        seen = Counter()
        for part in collocations._parts(pa.array([text]), k):
            w = part[0].as_py()
            w = (w.decode() if isinstance(w, bytes) else w).split()
            seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        w = text.split()
        assert seen == Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
