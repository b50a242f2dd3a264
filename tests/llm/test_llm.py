"""Operators against brute force, the library they stand for, or an exact way back."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import _graph, brown, chat, decontam, jaccard, secrets, sentencepiece_codec, sharding, topk, toxicity, warc

DOCS = "doc_id bigint, text string, extra string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# sharding


def test_table_is_filled_by_turns():
    names, slots = ["a", "b", "c"], 31
    taken, at = {}, [0] * 3
    prefs = []
    for x in names:
        o, s = (int(hashlib.md5(f"{salt}:{x}".encode()).hexdigest()[:15], 16) for salt in ("offset", "skip"))
        prefs.append([(o + k * (s % (slots - 1) + 1)) % slots for k in range(slots)])
    for turn in itertools.cycle(range(3)):
        while at[turn] < slots and prefs[turn][at[turn]] in taken:
            at[turn] += 1
        taken[prefs[turn][at[turn]]] = turn
        if len(taken) == slots:
            break
    assert sharding.lookup_table(names, slots) == [taken[i] for i in range(slots)]


def test_shards_are_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(names)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.1 * len(table)


@pytest.mark.parametrize("names,slots", [([], 31), (["a", "a"], 31), (["a"], 30), (["a", "b", "c"], 2)])
def test_bad_tables(names, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, slots)


def test_placement(spark):
    rows = [(i, "t", "x") for i in range(50)] + [(None, None, None), (None, "", "y"), (7, "again", "z")]
    got = sharding.place(frame(spark, rows), "doc_id", ["a", "b", "c"], 31).collect()
    table = sharding.lookup_table(["a", "b", "c"], 31)
    assert len(got) == len(rows)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 31 and r.shard == table[r.slot]
    assert sharding.place(frame(spark, []), "doc_id").count() == 0
    clash = sharding.place(frame(spark, rows).withColumnRenamed("extra", "slot"), "doc_id", ["a", "b", "c"], 31)
    assert clash.columns == ["doc_id", "text", "slot", "shard"] and {(r.doc_id, r.slot) for r in clash.collect()} == {(r.doc_id, r.slot) for r in got}
    by_clash = sharding.place(frame(spark, rows).withColumnRenamed("doc_id", "slot"), "slot", ["a", "b", "c"], 31)
    assert by_clash.columns == ["text", "extra", "slot", "shard"] and by_clash.count() == len(rows)


# toxicity


def test_toxicity_learns_and_is_whole(spark):
    r = random.Random(3)
    plain = ["tree", "river", "stone", "cloud", "green", "walk", "house", "light"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [r.choice(plain) for _ in range(r.randint(5, 40))]
        if bad:
            text.insert(r.randrange(len(text)), r.choice(["vilehead", "vilemouth", "vilesoul"]))
        rows.append((i, " ".join(text), "e"))
        labels.append((i, int(bad)))
    rows += [(1000, None, None), (1001, "", None), (1002, "tree " * 50_000, None), (5, rows[5][1], "again")]
    labels += [(0, 0), (3, None), (None, 1)]
    docs = frame(spark, rows)
    model = toxicity.fit(docs, frame(spark, labels[:400] + labels[600:], "doc_id bigint, toxic int"))
    assert len(model.bucket) < 200
    got = defaultdict(set)
    for x in toxicity.score(docs, model).collect():
        got[x.doc_id].add(x.score)
    assert len(got) == 603 and all(0 <= s <= 1 for v in got.values() for s in v)
    assert got[1000] == got[1001]
    right = sum((min(got[i]) >= 0.3) == bool(y) for i, y in labels[400:600])
    assert right >= 196
    clash = toxicity.score(docs.withColumnRenamed("extra", "score"), model)
    assert clash.columns == ["doc_id", "text", "score"] and clash.where("score between 0 and 1").count() == len(rows)
    assert toxicity.score(docs.limit(0), model).count() == 0
    # many rows of one labelled id are learnt as one
    same = toxicity.fit(docs.union(docs).union(docs), frame(spark, labels[:400] + labels[600:], "doc_id bigint, toxic int"))
    assert same.bucket.tolist() == model.bucket.tolist() and np.allclose(same.weight, model.weight)


def test_ftrl_against_brute_force():
    r = random.Random(15)
    rows = [(np.array(sorted(r.sample(range(16), r.randint(0, 9))), np.int64), r.randrange(2)) for _ in range(300)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.7, 0.01
    got = toxicity.ftrl(rows, 4, alpha, beta, l1, l2, 3)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        cut = 0.0 if k == 16 else l1
        if abs(z[k]) <= cut:
            return 0.0
        return -(z[k] - math.copysign(cut, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(3):
        for at, y in rows:
            keys = [*at.tolist(), 16]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k in keys:
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    want = {k: weight(k) for k in range(16) if weight(k)}
    assert np.allclose(got.weight, list(want.values()), atol=1e-5)
    assert got.bucket.tolist() == list(want) and math.isclose(got.bias, weight(16), abs_tol=1e-9)


def test_toxicity_features_and_scores_against_brute_force():
    r = random.Random(16)
    texts = ["", "One", "tree-house, Tree", *(" ".join(r.choice(["tree", "stone", "riverbank", "watermill", "é"]) for _ in range(r.randint(1, 30))) for _ in range(40))]

    def grams(text):
        w = [x.encode() for x in words(text)]
        out = {("w", x) for x in w} | {("p", k, x[:k]) for x in w for k in (4, 5, 6, 7, 8) if len(x) > k}
        return out | {("n", a, b) for a, b in zip(w, w[1:])} | {("s", a, b) for a, b in zip(w, w[2:])}

    both = toxicity.folded(pa.array(texts), 30)
    assert np.bincount(both >> 30, minlength=len(texts)).tolist() == [len(grams(t)) for t in texts]
    sets = [set((both[both >> 30 == i] & ((1 << 30) - 1)).tolist()) for i in range(len(texts))]
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert len(sets[i] & sets[j]) == len(grams(texts[i]) & grams(texts[j]))
    small = toxicity.folded(pa.array(texts), 12)
    chosen = np.unique(small & 4095)[::3]
    model = toxicity.Model(chosen.astype(np.int32), np.linspace(-1, 1, len(chosen)).astype(np.float32), -0.2, 12)
    table = np.zeros(1 << 12, np.float32)
    table[model.bucket] = model.weight
    want = [1 / (1 + math.exp(0.2 - sum(float(table[b]) for b in (small[small >> 12 == i] & 4095).tolist()))) for i in range(len(texts))]
    assert np.allclose(toxicity.scores(pa.array(texts), model, table), want)


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b", "x")])
    model = toxicity.fit(docs, frame(spark, [], "doc_id bigint, toxic int"))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.5]


# top-k


@pytest.mark.parametrize("same", [False, True])
def test_topk_against_brute_force(spark, same):
    r = np.random.default_rng(5)
    rows = [(i, [0.5] * 6 if same and i % 3 else r.normal(size=6).tolist()) for i in range(230)]
    rows += [(300, None), (301, [None] + [1.0] * 5), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (305, [1.0, 2.0]), (7, [1.0] * 6)]
    df = frame(spark, rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for x in topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block=3).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in clean:
        if q % 50 == 0:
            all_ = sorted(((-sum(a * b for a, b in zip(v, w)), c) for c, w in clean if c != q))[:5]
            assert got.pop(q) == [(k + 1, c, -s) for k, (s, c) in enumerate(all_)]
    assert not got


def test_topk_small_and_empty(spark):
    df = frame(spark, [(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), 5).collect()] == [(0, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


# WARC


def test_warc_way_back(spark):
    long = "é\r\n\r\nWARC/1.1 <p>" * 5000
    rows = [(3, "http://a", long), (1, "http://b\r\nX: y", long), (2, "u", None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, None, "y" * 100), (9, "u", "y" * 100), (9, "u", "y" * 100), (None, "u", "y" * 100)]
    pages = frame(spark, rows, "page_id bigint, url string, html string")
    from lodeweave.llm._store import new_path

    archives = warc.write(warc.plan(pages), new_path(spark, "t"))
    index = warc.normalise(archives, new_path(spark, "t"))
    got = sorted(((str(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index).collect()), key=repr)
    assert sorted(r.url for r in warc.read(index).collect()) == sorted(u or "" for _, u, _ in rows)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [x for x, _, y in rows if x is not None and (y or "") == (h or "")]
        again = len(data) >= 100 and (i is None or i > min(same))
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(min(same)) if again else None))
    assert got == sorted(want, key=repr)
    assert index.count() == len(rows)
    odd = [("a\r\nWARC-Type: evil", "u", "z" * 100), ("None", "u", "z" * 100), (None, "u", "z" * 100), ("100%>", "u%0D", "w"), ("none", "", "v")]
    index = warc.normalise(warc.write(warc.plan(frame(spark, odd, "page_id string, url string, html string")), new_path(spark, "t")), new_path(spark, "t"))
    got = {r.key: (r.url, r.record_type, r.refers_to) for r in warc.read(index).collect()}
    assert got == {odd[0][0]: ("u", "revisit", "None"), "None": ("u", "response", None), None: ("u", "revisit", "None"), "100%>": ("u%0D", "response", None), "none": ("", "response", None)}
    assert warc.normalise(warc.write(warc.plan(pages.limit(0)), new_path(spark, "t")), new_path(spark, "t")).count() == 0


def test_inflate_many_members_and_truncation():
    import gzip
    import io

    data = [bytes([i]) * 70_000 for i in range(4)]
    whole = b"".join(map(gzip.compress, data))
    assert b"".join(warc.inflate(io.BytesIO(whole), 1000)) == b"".join(data)
    with pytest.raises(ValueError):
        list(warc.stream_records(iter([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"])))


# chat


def test_chat_way_back(spark):
    r = random.Random(2)
    bits = ["###", "### assistant: ", " </turn>\n", "\\", "a", "é", "\n", " ", "</turn>", ": ", "#"]
    rows = [(c, t, r.choice(["user", "assistant", "we: ird\n", None, "#\\"]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (50, None, "assistant", "z"), (50, 0, "user", "u"), (50, 0, "user", "u"), (60, 0, "assistant", "long \\ " * 100_000)]
    df = frame(spark, rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(df)
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    got = {}
    for x in made.collect():
        assert x.part == 0
        got[x.conv_id] = chat.turns(x.formatted)
        raw = x.formatted.encode()
        assert [chat.unescape(raw[s.start : s.end].decode()) for s in x.loss] == [t for role, t in want[x.conv_id] if role == "assistant"]
    assert got == want
    for x in chat.digests(made).collect():
        assert x.n_turns == len(want[x.conv_id])
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[x.conv_id]).encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256("".join(b for a, b in want[x.conv_id] if a == "assistant").encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_parts(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t} " + "x" * 700_000) for t in range(20)] + [(2, 0, "user", "y")]
    df = frame(spark, rows, "conv_id bigint, turn bigint, role string, text string")
    got = {x.conv_id: x for x in chat.digests(chat.format_conversations(df, part_bytes=1 << 20)).collect()}
    assert {k: x.n_turns for k, x in got.items()} == {1: 20, 2: 1}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:20]).encode()).hexdigest()


def test_chat_rejects_what_it_did_not_write():
    with pytest.raises(ValueError):
        chat.turns("### user: a </turn>\nmore")


# decontamination


def test_decontamination_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünder", "the"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([12, 25, 10, 4, 1, 30])] + [(10, None), (11, "..."), (12, None), (2, "other words of that id here")]
    items.append((20, items[0][1]))
    rows = []
    for i in range(60):
        text = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            text[5:5] = words(items[i % 6][1])
        rows.append((i, ", ".join(text), "x"))
    rows += [(100, None, None), (101, "", None), (102, " ".join([items[0][1]] * 300), None), (3, rows[3][1], "again")]
    got = sorted((x.doc_id, x.n_words, x.n_hit, sorted(x["items"])) for x in decontam.decontaminate(frame(spark, rows), frame(spark, items, "item_id bigint, text string")).collect())
    want = []
    for i, text, _ in rows:
        w, hit, found = words(text), set(), set()
        for k, t in items:
            v = words(t)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(k)
        want.append((i, len(w), len(hit), sorted(found)))
    assert got == sorted(want)


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = frame(spark, [(1, item, None), (2, item.replace("zeta", "zeta x y"), None), (3, "alpha " + "z " * 50 + item[6:40], None), (4, "nothing here", None)])
    got = {x.doc_id: (x.n_near > 0, x.n_hit > 0) for x in decontam.decontaminate(docs, frame(spark, [(1, item)], "item_id bigint, text string")).collect()}
    assert got[1] == (True, True) and got[2][1] is False and got[4] == (False, False)
    empty = decontam.decontaminate(docs, frame(spark, [], "item_id bigint, text string")).collect()
    assert len(empty) == 4 and all(x.n_hit == 0 for x in empty)
    assert decontam.decontaminate(docs.limit(0), frame(spark, [(1, item)], "item_id bigint, text string")).count() == 0


# SentencePiece

def texts_for_pieces():
    r = random.Random(6)
    out = ["", " ", "   ", "Hello  world\n\tfoo ", "日本語😀\x00é", "a" * 5000, "▁a"]
    out += ["".join(r.choice("etaoinsh  r\n0é▁.") for _ in range(r.randint(1, 200))) for _ in range(300)]
    return out + ["".join(r.choice("etaoinshrdlu") for _ in range(3000))]


def test_pieces_equal_the_library(monkeypatch):
    spm = pytest.importorskip("sentencepiece")
    with open(sentencepiece_codec.MODEL, "rb") as f:
        data = f.read()
    model = sentencepiece_codec.load(data)
    library = spm.SentencePieceProcessor(model_proto=data)
    texts = [*texts_for_pieces(), "x▁ y", "a▁▁ ▁b\t\n c"]
    wanted = [library.encode(t) for t in texts]
    assert sentencepiece_codec.Encoder(model).batch(pa.array(texts)).to_pylist() == wanted
    # the streaming search over whole texts, with no border known beforehand
    monkeypatch.setattr(sentencepiece_codec, "search_window", lambda *_: [-1])
    for t, ids in zip(texts, wanted):
        whole = sentencepiece_codec.Encoder(model).searched("▁" + t.replace(" ", "▁")) if t else b""
        assert np.frombuffer(whole, np.int32).tolist() == ids


def test_search_commits_within_a_window():
    """What isn't committed stays bounded, and pieces come out while the text goes on."""
    with open(sentencepiece_codec.MODEL, "rb") as f:
        model = sentencepiece_codec.load(f.read())
    r = random.Random(14)
    text = "▁" + "▁".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 12))) for _ in range(3000))
    read = 0

    def ends(model, text):
        nonlocal read
        for read, x in enumerate(every(model, text), 1):
            yield x

    every, sentencepiece_codec._ends = sentencepiece_codec._ends, ends
    try:
        at, furthest = 0, 0
        for _, piece in sentencepiece_codec.search(model, text):
            at += len(piece)
            furthest = max(furthest, read - at) if read < len(text) else furthest
        assert at == len(text) and furthest <= 4 * model.longest
    finally:
        sentencepiece_codec._ends = every


def test_unigram_path_is_best():
    pieces = [("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -1.5, 1), ("ab", -1.8, 1), ("ba", -1.1, 1), ("aba", -3.9, 1), ("▁", -2.0, 1)]
    model = sentencepiece_codec.Model(pieces, sentencepiece_codec.UNIGRAM)
    r = random.Random(1)
    for n in (1, 2, 5, 9, 40, 41, 200):
        text = "".join(r.choice("abc") for _ in range(n))
        got = list(sentencepiece_codec.search(model, text))
        assert "".join(p for _, p in got) == text
        score = lambda path: sum(pieces[i][1] if i >= 0 else model.worst for i, _ in path)
        best = [0.0] + [-math.inf] * n
        for e in range(1, n + 1):
            for b in range(max(0, e - 3), e):
                i = model.ids.get(text[b:e], -1 if e - b == 1 else None)
                if i is not None:
                    best[e] = max(best[e], best[b] + (pieces[i][1] if i >= 0 else model.worst))
        assert math.isclose(score(got), best[n])


def test_pieces_way_back(spark):
    rows = [(i, t, None) for i, t in enumerate(texts_for_pieces()[:60])] + [(900, None, "x"), (901, "word " * 30_000, "y")]
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(frame(spark, rows))).collect()
    assert len(out) == len(rows)
    assert all(x.decoded == (x.text or "").replace("▁", " ") for x in out)
    clash = sentencepiece_codec.decode(sentencepiece_codec.encode(frame(spark, rows[7:9] * 2).withColumnRenamed("extra", "ids")))
    assert clash.columns == ["doc_id", "text", "ids", "decoded"] and clash.count() == 4
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(frame(spark, []))).count() == 0


# language model


def test_lm_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    a, b = ["un", "deux", "trois"], ["One", "two", "three", "four"]
    rows = [(i, " ".join(r.choice(a if i % 2 else b) + r.choice(["", "", "x", str(r.randrange(50))]) for _ in range(r.randint(0, 40))), None) for i in range(300)]
    rows += [(1000, None, None), (1001, "new\twords  only ", None), (5, rows[5][1], None), (None, "one two", None), (1003, "two " * 40_000, None)]
    docs = frame(spark, rows)
    train = docs.where(brown.in_training(F.col("doc_id")))
    monkeypatch.setattr(brown, "MARGIN", 0.5)
    model = brown.fit(train, head=20, cache=15, classes=8)
    got = brown.score(docs, model).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]
    import zlib

    c = Counter(w for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w := tokens(t)), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)) for i, t, _ in rows)
    assert sorted((str(x.doc_id), x.n_tokens, x.n_known, round(x.base_score, 5)) for x in got) == want
    assert {x.train_tokens for x in got} == {n}
    # the classes of all words and the scores, with plain loops; the types' classes are the driver's (tested below)
    def seen(t):
        h, tail, _ = brown.tokens(pa.array([t], pa.string()))
        return list(zip(h.tolist(), model.klass[model.types.of(h, tail)].tolist()))

    xlogx = lambda x: x * math.log(x) if x > 0 else 0.0
    K, end = 8, int(model.klass[-1])
    after, first = defaultdict(Counter), {}
    for i, t, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            g = end
            for h, own in seen(t):
                after[h][g] += 1
                first[h] = g = own
    at = dict(first)
    for p in range(brown.PASSES):
        pairs = Counter()
        for h, x in after.items():
            for g, k in x.items():
                pairs[g, at[h]] += k
        sums = [sum(pairs[g, k] for g in range(K)) for k in range(K)]
        moved = dict(at)
        for h, x in after.items():
            if h == 0 or int(brown._bytes.mix(np.array([h], np.uint64))[0]) % 2 != p % 2:
                continue
            gains = []
            for k in range(K - 1):
                less = lambda g: x[g] if k == at[h] else 0  # noqa: B023, E731
                size = sum(x.values())
                s = sums[k] - (size if k == at[h] else 0)
                gains.append(round(sum(xlogx(pairs[g, k] - less(g) + n_) - xlogx(pairs[g, k] - less(g)) for g, n_ in x.items()) - xlogx(s + size) + xlogx(s), 6))
            if max(gains) >= gains[at[h]] + brown.MARGIN:
                moved[h] = gains.index(max(gains))
        at = moved
    final = np.zeros((K, K))
    for h, x in after.items():
        for g, k in x.items():
            final[g, at[h]] += k
    assert np.array_equal(final, model.tables[-1])
    trans = brown._transitions(final)
    many, distinct = final.sum(axis=0), Counter(at.values())
    want = []
    for i, t, _ in rows:
        g, total = end, 0.0
        for h, own in seen(t):
            k = at.get(h, own)
            total += trans[g, k] + math.log10((sum(after[h].values()) if h in after else 0) + 0.5) - math.log10(many[k] + 0.5 * (distinct[k] + 1))
            g = own
        want.append((str(i), len(seen(t)), round(total, 4)))
    assert sorted((str(x.doc_id), x.n_tokens, round(x.score, 4)) for x in got) == sorted(want)
    assert sum(x.score for x in got) > sum(x.base_score for x in got)
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)


def test_lm_transitions_sum_to_one_and_empty(spark):
    p = brown._transitions(np.array([[3.0, 0, 1], [0, 0, 0], [2, 2, 2]]))
    assert np.allclose((10**p).sum(axis=1), 1)
    docs = frame(spark, [(1, "a b", None), (2, None, None)])
    got = brown.score(docs, brown.fit(docs.limit(0))).collect()
    assert [x.n_known for x in got] == [0, 0]
    assert brown.score(docs.limit(0), brown.fit(docs)).count() == 0


def test_exchange_separates_two_languages():
    r = random.Random(1)
    text = []
    for _ in range(400):
        k = r.randrange(2)
        text += [r.randrange(5) + 5 * k for _ in range(10)] + [10]
    pairs = Counter(zip(text, text[1:]))
    left, right = (np.array(x) for x in zip(*pairs))
    c = brown.exchange(left, right, np.array([float(n) for n in pairs.values()]), 11, classes=3)
    assert len(set(c[:5])) == 1 and len(set(c[5:10])) == 1 and len(set(c)) == 3


# secrets

ASSIGN = re.compile(secrets.ASSIGN.replace("(?i:", "(?:"), re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark):
    r = random.Random(9)
    bits = ["password", "SECRET", "api_key", "ApiKey", "token", ": ", "=", " = ", '"', "'", "abcd1234", "short", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "é😀", "\n", " ", "x."]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 25))), "e") for i in range(300)]
    random_key = "Zx9QpL3vTk7RwB2nYs8Gd5Hf"
    rows += [(1000, None, None), (1001, "", None), (1002, f"é see {random_key} here", None), (1003, "get_document_title_buffer2 and handleRequestContextQueue", None), (1004, "token: token: abcdefghij", None), (1005, "a" * 100_000, None), (1006, "secret=abcdefgh " * 800, None)]
    table = secrets.train(secrets.samples(spark))
    got = {x.doc_id: x for x in secrets.scan(frame(spark, rows), table).withColumn("clean", secrets.redacted(F.col("text"), F.col("spans"))).collect()}
    for i, t, _ in rows:
        assert [tuple(s) for s in got[i].base_spans] == base_spans(t or ""), t
        assert [tuple(s) for s in got[i].spans if s.kind < 3] == base_spans(t or "")
        clean, at = "", 0
        for s in got[i].spans:
            if s.start >= at:
                clean += (t or "")[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert got[i].clean == (None if t is None else clean + t[at:])
    assert [tuple(s) for s in got[1002].spans] == [(6, 3, 6 + len(random_key))]
    assert not got[1003].spans
    assert secrets.scan(frame(spark, rows).limit(0), table).count() == 0
    clash = secrets.scan(frame(spark, rows).withColumnRenamed("extra", "spans").withColumnRenamed("doc_id", "_text"), table)
    assert clash.columns == ["_text", "text", "base_spans", "spans"]
    assert {x[0]: [tuple(s) for s in x.spans] for x in clash.collect()} == {i: [tuple(s) for s in x.spans] for i, x in got.items()}


def test_secrets_of_very_long_texts(spark):
    """Many matches and tokens in one text: the work follows their number, and results stay exact."""
    table = secrets.train(secrets.samples(spark))
    r = random.Random(21)
    key = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    long = "secret=abcdefgh é" * 200_000
    keys = [key() for _ in range(30_000)]
    mixed = " token: abcdefgh1 ".join(keys)
    one = "".join(key() for _ in range(40_000))
    df = spark.createDataFrame([(1, long), (2, mixed), (3, one)], "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x for x in secrets.scan(df, table).select("doc_id", "base_spans", "spans", secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert [tuple(s) for s in got[1].base_spans] == [(17 * k, 0, 17 * k + 15) for k in range(200_000)]
    assert got[1].clean == "[SECRET] é" * 200_000
    assert [tuple(s) for s in got[2].base_spans] == base_spans(mixed)
    found = {s.start for s in got[2].spans if s.kind == 3}
    assert len(found) > 29_900 and found <= {42 * k for k in range(30_000)}
    clean, at = [], 0
    for s in got[2].spans:
        clean += [mixed[at : s.start], "[SECRET]"]
        at = s.end
    assert got[2].clean == "".join([*clean, mixed[at:]])
    assert [tuple(s) for s in got[3].spans] == [(0, 3, len(one))] and got[3].clean == "[SECRET]"


def test_ratio_of_stretches_is_that_of_the_whole(spark, monkeypatch):
    table = secrets.train(secrets.samples(spark))
    df = spark.createDataFrame([("aB3x" * 50 + "é9",), ("a",), ("ab",)], "t string")
    want = [x[0] for x in df.select(secrets.ratio(F.col("t"), table)).collect()]
    monkeypatch.setattr(secrets, "STRETCH", 7)
    assert np.allclose([x[0] for x in df.select(secrets.ratio(F.col("t"), table)).collect()], want)


def test_models_tell_random_from_ordinary(spark):
    table = secrets.train(secrets.samples(spark))
    held = secrets.samples(spark, 6000, 1_000_000).withColumn("n", F.monotonically_increasing_id())
    wrong = held.where("length(text) >= 20").withColumn("r", secrets.ratio(F.col("text"), table)).where((F.col("r") >= secrets.THRESHOLD) != (F.col("label") == 1)).count()
    assert wrong < 0.03 * held.count()
    assert secrets.train(held.limit(0).select("text", "label")) == [0.0] * 128 * 128


def test_scan_lets_the_ratio_decide(spark):
    r = random.Random(19)
    table = secrets.train(secrets.samples(spark))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"letters": letters + letters.upper(), "lower": letters, "digits": digits, "hex": digits + "abcdef", "all": letters + letters.upper() + digits}
    texts = [(k, "see " + "".join(r.choice(a) for _ in range(22)) + " here") for k, a in alphabets.items() for _ in range(300)]
    pick = lambda sep: sep.join(r.choice(secrets.IDENTIFIER_WORDS) for _ in range(5))
    texts += [("ordinary", x) for _ in range(100) for x in (pick("_"), pick("_").upper(), pick("/"), pick(""))] + [("ordinary", c * n) for c in "-=_/+aX0" for n in (20, 90)]
    got = Counter(x.kind for x in secrets.scan(spark.createDataFrame(texts, "kind string, text string"), table).where(F.exists("spans", lambda s: s["kind"] == 3)).collect())
    assert got["all"] == got["hex"] == 300 and got["letters"] > 290 and got["lower"] > 270 and got["digits"] > 230
    assert got["ordinary"] <= 4


# Jaccard join


def brute_links(rows):
    sets = defaultdict(list)
    for i, t, _ in rows:
        w = words(t)
        if w:
            sets[frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))].append(i)
    keys = list(sets)
    links, classes, root = Counter(), Counter(), {k: k for k in range(len(keys))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(keys)), 2):
        both = len(keys[a] & keys[b])
        if both >= 0.8 * len(keys[a] | keys[b]) - 1e-9:
            links[a] += len(sets[keys[b]])
            links[b] += len(sets[keys[a]])
            classes[a] += 1
            classes[b] += 1
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(keys)):
        groups[find(k)].append(min(sets[keys[k]]))
    out = {i: (i, 1, 0, 0, i) for i, t, _ in rows}
    for k, key in enumerate(keys):
        for i in sets[key]:
            out[i] = (min(sets[key]), len(sets[key]), links[k] + len(sets[key]) - 1, classes[k], min(groups[find(k)]))
    return out


@pytest.mark.parametrize("block", [1024, 16, 5])
def test_jaccard_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, i = [], 0
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 60, 200]))]
        for _ in range(60 if g == 0 else r.randint(1, 6)):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append((i, " ".join(text), "x"))
            i += 1
    rows += [(900, None, None), (901, "", None), (902, "!!", None), (903, "only", None), (904, "Only", None), (905, rows[0][1].upper(), None), (906, "long text " * 30_000, None)]
    got = {x.doc_id: tuple(x)[1:] for x in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_jaccard_blocks_with_an_empty_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 30)
    rows = []
    for g in range(16):
        base = " ".join(f"g{g}w{k}" for k in range(44))
        rows += [(2 * g, base, None), (2 * g + 1, base + " tail", None)]
    got = {x.doc_id: tuple(x)[1:] for x in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_links(rows)
    assert all(n_links == 1 and n_classes == 1 for _, _, n_links, n_classes, _ in got.values())


def test_components_of_chains_and_stars(spark):
    r = random.Random(12)
    nodes = list(range(400))
    r.shuffle(nodes)
    ties = [(max(a, b), min(a, b)) for a, b in zip(nodes[:300], nodes[1:300])] + [(max(x, 500), min(x, 500)) for x in nodes[300:]] + [(7, 7)]
    df = spark.createDataFrame(ties, "a bigint, b bigint")
    for edges in (df, _graph.starred(df)):
        got = {x.node: x.root for x in _graph.components(edges).collect()}
        assert got == {x: min(nodes[:300]) for x in nodes[:300]} | {x: min(nodes[300:]) for x in [*nodes[300:], 500]}


@pytest.mark.parametrize("block", [1024, 7])
def test_jaccard_exact_mode(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(13)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(r.randint(0, 4)):
            text[r.randrange(len(text))] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(text), None))
    rows += [(100, None, None), (101, "w1 w2", None), (102, rows[0][1], None)]
    got = {x.doc_id: tuple(x)[1:] for x in jaccard.near_duplicates(frame(spark, rows), exact=True).collect()}
    assert got == brute_links(rows)


def test_prefixes_of_similar_sets_hold_their_smallest_common_shingle():
    r = np.random.default_rng(5)
    for _ in range(300):
        base = np.unique(r.integers(0, 10_000, r.integers(1, 60)).astype(np.uint64))
        other = np.union1d(base[r.random(len(base)) < 0.9], r.integers(0, 10_000, r.integers(0, 8)).astype(np.uint64))
        both = np.intersect1d(base, other)
        for t in (0.5, 0.8, 1.0):
            if len(both) and len(both) >= t * (len(base) + len(other) - len(both)):
                assert both[0] in jaccard.prefix(base, t) and both[0] in jaccard.prefix(other, t)


def test_jaccard_recall_over_thousands_of_links(spark):
    """Many links at the threshold itself: candidates by bands and pruning against the mode that loses none, for components of any size."""
    r = random.Random(17)
    rows = []
    for g in range(100):
        base = [f"g{g}w{k}" for k in range(130)]
        for _ in range(25):
            text = list(base)
            for k in r.sample(range(130), r.randint(1, 3)):
                text[k] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(text), None))
    df = frame(spark, rows)
    want, got = ({x.doc_id: x.n_links for x in jaccard.near_duplicates(df, exact=e).collect()} for e in (True, False))
    assert sum(want.values()) > 2 * 5000 and all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.999 * sum(want.values())


def test_jaccard_repeated_and_null_ids(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (1, text, "b"), (1, "other words that are not alike at all", "c"), (None, text, None), (None, "a b c d e f g", None), (2, None, None)]
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(x.n_copies for x in got) == [1, 1, 1, 3, 3, 3]
    assert jaccard.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_posterior_bounds():
    for n, m in jaccard.least_matches():
        tail = lambda k: sum(math.comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(k + 1))
        assert tail(m) >= 1e-4 and (m == 0 or tail(m - 1) < 1e-4)


def test_block_overlaps_agree():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, 80).astype(np.uint64)) for _ in range(90)]
    pairs = np.array([(i, j) for i in range(90) for j in range(i)])
    assert len(pairs) > 2000
    want = [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in pairs]
    assert jaccard._overlaps(sets, sets, pairs).tolist() == want
    assert jaccard._overlaps(sets, list(sets), pairs).tolist() == want
    assert jaccard._overlaps(sets, sets, pairs[:50]).tolist() == want[:50]
