"""Groups and top N: brute force on random data, and the defined cases."""

import math
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from quarry import skew
from quarry.llm import groups, topn
from quarry.operators import pointers

PAIRS = "run string, a string, b string, h string, extra int, v long"


def brute(rows):
    up = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for s, a, b, h, *_ in rows:
        ends = [(s, "f", x) for x in (a, b) if x is not None]
        for e in ends:
            up.setdefault(e, e)
        if ends and h:
            up.setdefault((s, "k", h), (s, "k", h))
            ends.append((s, "k", h))
        for e in ends[1:]:
            x, y = find(ends[0]), find(e)
            up[x] = y
    least = {}
    for e in up:
        if e[1] == "f":
            r = find(e)
            least[r] = min(least.get(r, e[2]), e[2])
    return sorted(((e[0], e[2], least[find(e)]) for e in up if e[1] == "f"), key=str)


def solve(spark, rows):
    df = spark.createDataFrame(rows, PAIRS)
    out = groups.group_matches(df, F.col("run"), F.col("a"), F.col("b"), F.col("h"))
    return sorted((tuple(r) for r in out.select("scope", "file_path", "group_id").collect()), key=str)


def test_groups_leave_no_shuffle_files_of_their_rounds(spark):
    df = spark.createDataFrame([("r", f"f{i}", f"f{i * 7 % 900}", f"h{i % 50}", 0, 0) for i in range(1000)], PAIRS)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles

    def written():
        found = files()
        return sum(found.apply(i).length() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_"))

    before = written()
    groups.group_matches(df, F.col("run"), F.col("a"), F.col("b"), F.col("h"))  # its last join has not run yet
    for _ in range(50):  # they go in the background; what counts and checks for clashes shuffled may stay
        if (more := written() - before) < 10_000:
            break
        time.sleep(0.1)
    assert more < 10_000, more


@pytest.mark.parametrize("seed", range(3))
def test_random_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(160):
        n = 70
        pick = lambda: rnd.choice([f"p{rnd.randrange(n)}"] * 12 + [None])  # noqa: E731, B023
        rows.append((rnd.choice(["r1", "r2", None]), pick(), pick(), rnd.choice([None, "", "h1", f"h{rnd.randrange(40)}"] if rnd.random() < 0.2 else [None]), 1, 1))
    assert solve(spark, rows) == brute(rows)


def test_shapes(spark, monkeypatch):
    chain = [("r", f"c{i:03}", f"c{i + 1:03}", None, 1, 1) for i in range(90)]
    star = [("r", "hub", f"s{i:03}", None, 1, 1) for i in range(90)]
    shared = [("r", f"x{i:03}", f"x{i:03}", "same", 1, 1) for i in range(60)]
    rows = chain + star + shared + [("r", "me", "me", None, 1, 1), ("q", "c000", "hub", "same", 1, 1)] + chain[:5] + [(s, b, a, h, e, v) for s, a, b, h, e, v in chain[:5]]
    want = brute(rows)
    assert solve(spark, rows) == want
    monkeypatch.setattr(skew, "HOT_ROWS", 20)  # the hub, the shared key and the large group are hot, nothing else is broadcast
    monkeypatch.setattr(pointers, "BROADCAST_ROWS", 0)
    assert solve(spark, rows) == want
    monkeypatch.setattr(groups, "NARROW_ROWS", 0)  # 128 bits
    assert solve(spark, rows) == want
    assert solve(spark, []) == []


def test_order_code_is_exact(spark):
    rnd = random.Random(2)
    xs = [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(400)]
    xs = [x for x in xs if x == x] + [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, 1.0, 2.0, 4.0, 0.1, 0.3, 100.0, 99.9, 8.0, math.nextafter(8.0, 0), math.nextafter(8.0, 9)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", topn.order_code(F.col("x")).alias("c")).collect()
    rows.sort(key=lambda r: r["x"])
    for a, b in zip(rows, rows[1:]):
        assert (a["c"] < b["c"]) if a["x"] < b["x"] else a["c"] == b["c"]
    assert spark.createDataFrame([(None,), (math.nan,)], "x double").select(topn.order_code(F.col("x")).alias("c")).distinct().count() == 1


def best(rows, n):
    low = lambda v: -math.inf if v is None or v != v else v + 0.0
    out = []
    for g in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == g and r[1] is not None and r[2] is not None and r[2] == r[2]]
        own.sort(key=lambda r: (-low(r[2]), -low(r[3]), r[1].encode()))
        out += [(g, i + 1, r[1]) for i, r in enumerate(own[:n])]
    return sorted(out)


def test_top_n_random(spark, monkeypatch):
    rnd = random.Random(4)
    rows = []
    for g, size in (("big", 900), ("ties", 400), ("few", 4), ("one", 1)):
        for i in range(size):
            score = rnd.choice([None, math.nan, rnd.gauss(0, 1) * 10 ** rnd.randint(-5, 5)]) if g == "big" and rnd.random() < 0.1 else (7.5 if g == "ties" else round(rnd.uniform(-50, 50), 1))
            rows.append((g, f"services/deep/common/prefix/{g}{'é' * (i % 3)}/{i}", score, rnd.choice([None, 1.0, -0.0, 0.0, math.nan]), 1))
    rows += [(None, "x", 1.0, 1.0, 1), ("few", None, 99.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, id string, s double, t double, tn_g int")
    for few, hot in ((5_000, 50_000), (0, 100)):  # all cuts broadcast; those of the hot groups only
        monkeypatch.setattr(topn, "BROADCAST_ROWS", few)
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
        got = topn.top_n(df, F.col("g"), [F.col("s"), F.col("t")], F.col("id"), 10)
        assert sorted(map(tuple, got.collect())) == best(rows, 10)
    empty = topn.top_n(df.limit(0), F.col("g"), [F.col("s")], F.col("id"), 10)
    assert empty.count() == 0
