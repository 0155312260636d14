"""Encoding against the vocabulary's own library; mixes against their invariants."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, mix

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["", None, " ", "  \n\t ", "Hello world, it's 2024!", "<|endoftext|> stays text", "naïve café 한국어 😀😀", "aaaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x01", "don't I'LL we'd", "\r\n\r\n x", "𝔘𝔫𝔦", "a" * 3000, "ab" * 2500, " " * 500 + "x"]


def test_equals_the_library(theirs):
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("aabbcdeest  \n\té한😀'lx0") for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    v = bpe.Vocabulary.of(bpe.default_vocabulary())
    got = [i for b in v.encode(texts) for i in b]
    want = [e.ids for e in theirs.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == want
    assert all(v.decode(i) == (t or "").encode() for i, t in zip(got, texts))


def test_exact_merging_alone(theirs):
    v = bpe.Vocabulary.of(bpe.default_vocabulary())
    for w in ("hello", "antidisestablishmentarianism", "zzzzqqq", "ааа"):
        assert v.merge(w.encode()) == theirs.encode(w, add_special_tokens=False).ids


def test_column(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    out = bpe.encode_column(df.select("doc_id", "text"), "text")
    assert out.columns == ["doc_id", "ids"] and out.filter("size(ids) = 0").count() == 2
    n = bpe.encode_column(df.select("doc_id", "text"), "text", "n", counts_only=True)
    assert n.join(out, "doc_id").filter(F.col("n") != F.size("ids")).count() == 0
    assert bpe.encode_column(df.limit(0).select("doc_id", "text"), "text").count() == 0


def docs(spark, n=300):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        s = rnd.choice(["big"] * 6 + ["small", "tiny", None, "zero"])
        rows.append((i, rnd.choice([None, "", "same text here"]) if rnd.random() < 0.05 else " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randint(1, 40))) + f" {i}", s, "clash"))
    rows += [(1000 + i, f"shared words number {i % 7} repeated", s, "") for i, s in enumerate(["big", "small", "tiny"] * 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string")


TARGETS = [("big", 2.0, 1), ("small", 5.0, 3), ("tiny", 5.0, 2), ("absent", 1.0, 4), ("zero", 0.0, 1)]


def test_mix(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_weight double, max_repeats int")
    d = docs(spark)
    m, s = mix.draw_mix(d, t)
    rows = m.collect()
    limits = {x: r for x, _, r in TARGETS}
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in d.collect()}
    seen = {}
    for r in rows:
        assert texts[r["doc_id"]][1] == r["source"] and 1 <= r["repeats"] <= limits[r["source"]]
        seen[texts[r["doc_id"]][0]] = seen.get(texts[r["doc_id"]][0], 0) + 1
    assert max(seen.values()) == 1  # every text for one source only
    shares = {r["source"]: r for r in s.collect()}
    assert set(shares) == set(limits) and shares["absent"]["mix_tokens"] == 0 == shares["zero"]["mix_tokens"]
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    for x, r in shares.items():
        own = [q for q in rows if q["source"] == x]
        assert r["mix_tokens"] == sum(q["n_tokens"] * q["repeats"] for q in own) <= r["quota_tokens"]
        if r["highest_repeat"] < limits[x] and own:
            assert r["quota_tokens"] - r["mix_tokens"] < 100
    again = mix.draw_mix(d.repartition(5), t)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_mix_of_nothing(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_weight double, max_repeats int")
    m, s = mix.draw_mix(docs(spark).limit(0), t)
    assert m.count() == 0 and s.count() == 5 and s.agg(F.sum("actual_share")).first()[0] == 0


def test_flow_prefers_sparing_repetition():
    f = mix.min_cost_flow({("a", "b"): 10, ("a",): 10}, {"a": mix.repetition_segments(10, 1), "b": mix.repetition_segments(20, 3)})
    assert f == {(("a", "b"), "b"): 10, (("a",), "a"): 10}
    assert mix.repetition_segments(12, 3) == [(4, 3), (2, 2), (6, 1)]


def test_largest_total_fills_every_share():
    from quarry.llm.mix import largest_total

    supply = {("a",): 100, ("b",): 40, ("a", "b"): 20, ("c",): 10}
    # c holds 10 and may be repeated three times: 30 tokens are a fifth of the mix
    assert largest_total(supply, {"a": 2.0, "b": 2.0, "c": 1.0}, {"a": 1, "b": 1, "c": 3}) in range(148, 155)
    assert largest_total(supply, {"b": 1.0}, {"b": 1}) == 60 and largest_total({}, {}, {}) == 0
