"""Hierarchies: brute force on random forests with cycles, and the defined cases."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry import skew
from quarry.operators import hierarchy, pointers
from quarry.operators.hierarchy import descendants, resolve

T0 = datetime(2024, 1, 1)
SCHEMA = "id string, up string, name string, at timestamp, h long, root string"


def brute(rows):
    best = {}
    for i, up, name, at, *_ in rows:
        if i:
            k = i.lower()
            if k not in best or at > best[k][0]:
                best[k] = (at, (up or "").lower() or None, name)
    out = {}
    for k in best:
        chain, cur = [k], k
        while True:
            up = best[cur][1]
            if up is None or up not in best:
                out[k] = (chain[-1], len(chain) - 1, ".".join(best[c][2] or "" for c in reversed(chain)))
                break
            if up in chain:
                out[k] = (min(chain[chain.index(up) :]), -1, None)
                break
            chain.append(up)
            cur = up
    return out


def solve(spark, rows, named=True):
    df = spark.createDataFrame(rows, SCHEMA)
    out = resolve(df, F.col("id"), F.col("up"), [F.col("at")], F.col("name") if named else None)
    return {r["symbol_id"]: (r["root_id"], r["tree_depth"], r["path"] if named else None) for r in out.collect()}


def test_random_forests_with_cycles(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(220):
        up = f"n{rnd.randint(max(0, i - 4), i)}" if rnd.random() < 0.85 else rnd.choice([None, "", "gone"])
        rows.append((f"N{i}" if rnd.random() < 0.5 else f"n{i}", up, rnd.choice(["a", "b", None]), T0, 1, "x"))
    rows += [(f"c{i}", f"C{(i + 1) % 7}", "c", T0, 1, "") for i in range(7)] + [("t1", "c3", "t", T0, 1, ""), ("t2", "T1", "t", T0, 1, ""), ("self", "SELF", "s", T0, 1, "")]
    rows += [("n5", None, "late", T0 + timedelta(days=1), 1, ""), (None, "n1", "q", T0, 1, ""), ("", "n1", "q", T0, 1, "")]
    want = brute(rows)
    assert solve(spark, rows) == want


def test_a_deep_chain_and_an_empty_table(spark):
    rows = [(f"d{i}", f"d{i - 1}" if i else None, "x", T0, 1, "") for i in range(300)]
    got = solve(spark, rows, named=False)
    assert got["d299"][:2] == ("d0", 299) and len(got) == 300
    assert solve(spark, []) == {}


def test_descendants(spark):
    rows = [("a", None, "", T0, 1, ""), ("b", "a", "", T0, 1, ""), ("c", "B", "", T0, 1, ""), ("d", "c", "", T0, 1, ""), ("e", "a", "", T0, 1, ""), ("x", "y", "", T0, 1, ""), ("y", "x", "", T0, 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, descendants(df, F.col("id"), F.col("up"), [F.col("at")]).collect()))
    assert got == sorted([("a", "b", 1), ("a", "e", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)])


def test_descendants_on_and_below_cycles(spark):
    rnd = random.Random(5)
    rows = [(f"n{i}", f"N{rnd.randint(max(0, i - 4), i)}" if rnd.random() < 0.85 else rnd.choice([None, "", "gone"]), "", T0, 1, "") for i in range(60)]
    rows += [(f"c{i}", f"C{(i + 3) % 7}", "c", T0, 1, "") for i in range(7)] + [("t1", "c3", "t", T0, 1, ""), ("t2", "T1", "t", T0, 1, ""), ("t3", "t2", "t", T0, 1, ""), ("x", "y", "", T0, 1, ""), ("y", "x", "", T0, 1, "")]
    up = {i.lower(): (u or "").lower() for i, u, *_ in rows}
    want = []
    for node in up:
        seen, at = [node], up[node]
        while at in up and at not in seen:
            want.append((at, node, len(seen)))
            seen.append(at)
            at = up[at]
    got = descendants(spark.createDataFrame(rows, SCHEMA), F.col("id"), F.col("up"), [F.col("at")], cyclic=True)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_wide_parents_and_wide_codes(spark, monkeypatch):
    """A parent of half of all rows, with the joins of hot keys, no broadcasts by size and 128-bit codes."""
    rows = [(f"w{i}", "top", "w", T0, 1, "") for i in range(60)] + [("top", None, "t", T0, 1, "")] + [(f"d{i}", f"d{i - 1}" if i else "w3", "d", T0, 1, "") for i in range(40)]
    rows += [("c1", "c2", "c", T0, 1, ""), ("c2", "c1", "c", T0, 1, "")] + [(f"b{i}", "c1", "b", T0, 1, "") for i in range(30)]
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(pointers, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pointers, "BROADCAST_ROWS_PATHS", 0)
    monkeypatch.setattr(hierarchy, "BROADCAST_ROWS_PATHS", 0)
    monkeypatch.setattr(hierarchy, "NARROW_ROWS", 0)
    assert solve(spark, rows) == brute(rows)
