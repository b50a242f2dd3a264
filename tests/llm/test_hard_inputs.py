"""Inputs that are easy to write and hard on an operator: large components, long turns, texts made to collide."""

import re
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import _bytes, chat, decontam, jaccard, secrets, sentencepiece_codec, topk


def test_scores_that_fit_are_exact_and_others_are_refused(spark):
    kind = "vec_id bigint, embedding array<double>"
    rng = np.random.default_rng(1)
    big = [(i, [float(x) for x in rng.integers(-(10**6), 10**6, 3) * 5]) for i in range(60)]  # scores of up to 4.9e18 / 2
    table = spark.createDataFrame(big, kind).repartition(3)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table, table.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect()]
    whole = {i: [int(256 * x) for x in v] for i, v in big}
    want = []
    for q in (0, 20, 40):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q))[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    assert got == want
    for x in (1e7, 1e12, 1e16, 1e300):
        rows = spark.createDataFrame([(0, [x, x]), (1, [x, -x]), (2, [1.0, x])], kind)
        with pytest.raises(ValueError):
            topk.top_k(rows, rows.where("vec_id = 0"), 5)
    # a repeated query id: one of its rows asks, and none of them is its candidate
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, [1.0, 1.0]), (2, None), (None, [9.0, 9.0])], kind)
    assert [(r.vec_id, r.score) for r in topk.top_k(rows, rows.where("vec_id = 0"), 5).collect()] == [(1, 256 * 256 * 3)]


def test_long_turns_take_memory_in_proportion():
    text = "one word after another </turn>\n### and \\ more " * 200_000
    roles, texts = pa.array(["us:er", "assistant"]), pa.array([text, "short "])
    data, *_ = chat.assemble(roles, texts, np.array([False, True]))
    formatted = data.tobytes().decode()
    tracemalloc.start()
    for (role, said), want in zip(chat.each_turn(formatted), [("us:er", text), ("assistant", "short ")], strict=True):
        assert (role, said) == want
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(formatted)
    tracemalloc.start()
    plain = "### user: " + "x" * 30_000_000 + " </turn>\n"
    assert [len(said) for _, said in chat.each_turn(plain)] == [30_000_000]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(plain)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_made_to_collide():
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    for k in (16, 32, 64, 1024):
        h = _bytes.words(pa.array([f"{one[:k]} {other[:k]}"]), _bytes.DENSE).hashes()
        assert len(set(h.tolist())) == 2
    sets, at = jaccard.shingles(pa.array([one, other]))
    assert sets[at[0]] != sets[at[1]]
    ids = sentencepiece_codec.encoder_of(Path(sentencepiece_codec.MODEL).read_bytes()).batch(pa.array([one, other])).to_pylist()
    assert ids[0] != ids[1]


def test_hashes_follow_words_wherever_they_stand():
    rng = np.random.default_rng(2)
    words = sorted({bytes(rng.integers(97, 100, rng.integers(1, 90)).astype(np.uint8)).decode() for _ in range(3000)})
    alone = [int(_bytes.words(pa.array([w]), _bytes.DENSE).hashes()[0]) for w in words]
    assert len(set(alone)) == len(words)
    together = _bytes.words(pa.array([" ".join(words[:1000]), *words[1000:]]), _bytes.DENSE)
    assert together.hashes().tolist() == alone
    assert together.hashes(3).tolist() == [int(_bytes.words(pa.array([w[:3]]), _bytes.DENSE).hashes()[0]) for w in words]


def test_columns_of_the_secret_scan(spark, tmp_path):
    spark.createDataFrame([(1, "token = abcdefgh1", "en", "s", 17)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert secrets.op9_secret_scan(spark, str(tmp_path)).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"]


def test_words_are_cut_apart_and_not_matched_one_by_one(spark):
    """A-Z alone are lower-cased, and it takes well below the time of a match for each word of a translated text."""
    odd = ["ÄRGER Ärger äRGER İI ſK K", "...A\x7fB\x00C[D]`E{F}", "", "!!!", "x", " x", "x ", "Straße\u2028Zeile\xa0Z 日本 A日", "\U0001d400A🙂B 0/9:@Z[a`z{", None, "A" * 70 + "É"]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, text string")
    for r in rows.select("i", decontam.words_of(F.col("text")).alias("w"), decontam.cased_words(F.col("text")).alias("c")).collect():
        want = re.findall(pattern, (odd[r.i] or "").translate(lower))
        assert r.w == want and [x.translate(lower) for x in r.c] == want, odd[r.i]
    text = " ".join(f"Word{i} of a Text, größer" for i in range(600))
    many = spark.range(400, numPartitions=1).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("text"))
    one_by_one = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(pattern), F.lit(0))

    def seconds(words):
        began = time.perf_counter()
        assert many.agg(F.sum(F.size(words))).first()[0] == 400 * 3000
        return time.perf_counter() - began

    took = [(seconds(decontam.words_of(F.col("text"))), seconds(one_by_one)) for _ in range(8)]
    assert min(a for a, _ in took) < 0.8 * min(b for _, b in took), took


def test_new_words_are_searched_together():
    """Words never seen before have the ids of the search one by one, in well below its time."""
    with open(sentencepiece_codec.MODEL, "rb") as f:
        data = f.read()
    rng = np.random.default_rng(7)
    letters = np.array(list("etaoinshrdluéñ,.'中0"))
    words = sorted({"".join(rng.choice(letters, n)) for n in rng.integers(1, 16, 60_000)}) + ["", " ", "\x00a", "a\n b", "😀😀", "x▁y", "日本語日本語日本語日本語日本語日本語", "e" * 16, "é" * 15, "é" * 16, "e" * 40]
    one, both = sentencepiece_codec.Encoder(sentencepiece_codec.load(data)), sentencepiece_codec.Encoder(sentencepiece_codec.load(data))
    assert both.windows is not None

    def seconds(work):
        began = time.thread_time()
        work()
        return time.thread_time() - began

    column = pa.array(words)
    one_by_one = lambda: [one.searched("▁" + w.replace(" ", "▁")) if w else b"" for w in words]
    together = lambda: both.batch(column)
    assert together().to_pylist() == [np.frombuffer(x, np.int32).tolist() for x in one_by_one()]
    took = []
    for _ in range(3):
        both.new.clear(), both.old.clear()
        took.append((seconds(together), seconds(one_by_one)))
    assert min(a for a, _ in took) < 0.8 * min(b for _, b in took), took
    # a character without a piece gives None, and is left to the search of one text
    small = sentencepiece_codec.Model([("<unk>", 0.0, 2), ("<0x61>", 0.0, 6), ("▁", -1.0, 1), ("a", -2.0, 1), ("b", -3.0, 1), ("ab", -4.0, 1), ("▁a", -5.0, 1), ("bab", -6.0, 1), ("abab", -7.0, 1)])
    texts = ["▁" + "".join(rng.choice(["a", "b"], n)) for n in rng.integers(0, 3, 50)] + ["ab", "abab", "bab", "▁", "b", "zab", "aab"]
    got = sentencepiece_codec.Windows(small).search([t.replace("▁", " ").encode() for t in texts])
    for t, ids in zip(texts, got):
        alone = sentencepiece_codec.search_window(small, t)
        assert (np.frombuffer(ids, np.int32).tolist() if ids is not None else None) == (None if -1 in alone else alone), t
