"""Mixing sources to target weights.

Texts that are equal count as one text, which may lie in several sources. Texts are aggregated by membership pattern
(the set of sources that hold them); the number of patterns is small however many texts there are, and is checked.
A min-cost flow routes each pattern's tokens to the sources, every text to one source only: a source's quota is filled
by the distinct tokens routed to it, repeated as needed. The cost of repetition is convex (the first tokens of a source
are worth most, as they would be repeated most), so overlapping texts go where they spare the most repetition. Then
texts are drawn in a seeded order: prefix sums over hash ranges find each text's place in its pattern, the flow cuts
the order into one stretch per source, and full passes plus a part of one more fill the quota.

Prefix sums run over hash buckets of bounded size, so no task holds a source, however large.

Defined results
* quota = total_tokens * weight / sum of the weights of the sources that hold any tokens. ``total_tokens`` defaults to the largest
  mix in which every such source can fill its quota within its ``max_repeats``, so the actual shares are the targets
  over the present sources (``reachable_share``), but for less than one text's repetitions per source. ``target_share`` is over all sources.
* With a larger total given, a source whose distinct tokens times ``max_repeats`` fall short contributes all of them; nobody else takes over
  the rest, and the report shows it.
* Drawing stops before the quota would be exceeded; the part missing is below the tokens of one text.
* Null and unknown sources, sources of weight 0 or null, and texts without tokens (null, empty) are never drawn. An absent source has actual share 0.
* A null max_repeats is 1. Several target rows of one source: the greatest weight counts. No documents: shares are 0.
* Same documents and seed, same mix, in whatever order the rows come.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import encode_column
from quarry.scratch import Scratch

#: Texts in a hash bucket, on average; bound on sources and on patterns that the flow is solved for.
BUCKET_TEXTS, MAX_SOURCES, MAX_PATTERNS = 20_000, 10_000, 100_000


def min_cost_flow(supply: dict[tuple[str, ...], int], segments: dict[str, list[tuple[int, int]]]) -> dict[tuple[tuple[str, ...], str], int]:
    """Route ``supply`` (pattern -> amount) to sources; ``segments`` are a source's (capacity, value) pieces of falling
    value. Maximises the total value, by successive cheapest augmenting paths. -> (pattern, source) -> amount."""
    names = [*supply, *segments]
    index = {n: i + 1 for i, n in enumerate(names)}
    sink = len(names) + 1
    head: list[list[int]] = [[] for _ in range(sink + 1)]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            head[x].append(len(to))
            to.append(y)
            cap.append(cc)
            cost.append(ww)
        return len(to) - 2

    routes = {}
    for p, amount in supply.items():
        arc(0, index[p], amount, 0)
        for s in p:
            if s in segments:
                routes[p, s] = arc(index[p], index[s], amount, 0)
    for s, parts in segments.items():
        for c, v in parts:
            if c > 0:
                arc(index[s], sink, c, -v)
    while True:
        dist, via, queued = {0: 0}, {}, {0}
        queue = deque([0])
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in head[x]:
                d = dist[x] + cost[e]
                if cap[e] > 0 and d < dist.get(to[e], 1 << 60):
                    dist[to[e]], via[to[e]] = d, e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if dist.get(sink, 0) >= 0:
            break
        path, x = [], sink
        while x:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount
    return {k: cap[e ^ 1] for k, e in routes.items() if cap[e ^ 1]}


def largest_total(supply: dict[tuple[str, ...], int], weights: dict[str, float], repeats: dict[str, int]) -> int:
    """Most tokens of a mix in which every source in ``weights`` fills its share with texts of its own, repeated as allowed."""
    whole = sum(weights.values())
    if not whole:
        return 0

    def fits(total: int) -> bool:
        need = {s: -(-int(total * w / whole) // repeats[s]) for s, w in weights.items()}
        return sum(min_cost_flow(supply, {s: [(n, 1)] for s, n in need.items()}).values()) == sum(need.values())

    low, high = 0, sum(supply.values()) * max(repeats.values())
    while low < high:
        mid = (low + high + 1) // 2
        if fits(mid):
            low = mid
        else:
            high = mid - 1
    return low


def repetition_segments(quota: int, repeats: int) -> list[tuple[int, int]]:
    """Pieces of distinct tokens and what each is worth: with quota / r distinct tokens everything occurs r times."""
    cuts = [0, *[quota // r for r in range(repeats, 0, -1)]]
    return [(b - a, r) for a, b, r in zip(cuts, cuts[1:], range(repeats, 0, -1))]


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = (
        targets.filter("source is not null").groupBy("source").agg(F.max(F.struct(F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("r"))).alias("t"))
        .select("source", "t.w", "t.r").limit(MAX_SOURCES + 1).collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with targets")
    return sorted((r[0], max(0.0, float(r[1])), max(1, int(r[2]))) for r in rows)


def draw_mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    mix: doc_id (the least one that holds the text in the source), source, n_tokens, repeats.
    shares: source, target_share, reachable_share, actual_share, quota_tokens, mix_tokens, distinct_tokens, texts, highest_repeat.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    wanted = _targets(targets)
    weights = sum(w for _, w, _ in wanted)
    active = {s: (w, r) for s, w, r in wanted if w > 0}
    kept = documents.select("doc_id", "text", "source").filter(F.col("source").isin(list(active)) & F.col("text").isNotNull() & (F.col("text") != ""))
    keyed = kept.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    counted = encode_column(keyed, "text", "n_tokens", vocabulary, counts_only=True)
    held = counted.groupBy("key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = scratch.write(
        held.groupBy("key").agg(F.max("n_tokens").alias("n_tokens"), F.map_from_entries(F.collect_list(F.struct("source", "doc_id"))).alias("docs"))
        .filter("n_tokens > 0").withColumn("pattern", F.array_join(F.array_sort(F.map_keys("docs")), "\u0001")).withColumn("u", F.xxhash64(F.lit(seed), "key"))
    )
    sums = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    supply = {tuple(r[0].split("\u0001")): r[1] for r in sorted(sums)}
    held_by = {s for p in supply for s in p}
    present = {s: w for s, (w, _) in active.items() if s in held_by}
    reach = sum(present.values())
    total = largest_total(supply, present, {s: active[s][1] for s in present}) if total_tokens is None else total_tokens
    quota = {s: int(total * w / reach) if s in present else 0 for s, w, _ in wanted}
    flow = min_cost_flow(supply, {s: repetition_segments(quota[s], r) for s, (_, r) in active.items()})
    # stretches of each pattern's order, one per source, and where they continue the source's own order
    stretches, used, so_far = [], {}, dict.fromkeys(active, 0)
    for (p, s), amount in sorted(flow.items()):
        start = used.get(p, 0)
        stretches.append(("\u0001".join(p), s, start, start + amount, so_far[s]))
        used[p] = start + amount
        so_far[s] += amount
    if len(stretches) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} stretches of patterns")
    plan = spark.createDataFrame(stretches, "pattern string, source string, lo long, hi long, base long")
    most = max((r[2] for r in sums), default=1)
    buckets = max(16, -(-most // BUCKET_TEXTS))
    placed = texts.withColumn("bucket", F.pmod(F.shiftrightunsigned("u", 1), F.lit(buckets)))
    before = placed.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("here")).withColumn("start", F.sum("here").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("here")).select("pattern", "bucket", "start")
    within = Window.partitionBy("pattern", "bucket").orderBy("u", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("inner", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(before, ["pattern", "bucket"]).withColumn("at", F.col("start") + F.col("inner"))
    plan = F.broadcast(plan)  # at most MAX_PATTERNS rows
    fits = (placed["pattern"] == plan["pattern"]) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
    routed = scratch.write(
        placed.join(plan, fits).select(F.col("docs")[F.col("source")].alias("doc_id"), "source", "n_tokens", (F.col("at") - F.col("lo") + F.col("base")).alias("at"))
    )
    have = {r[0]: r[1] for r in routed.groupBy("source").agg(F.sum("n_tokens")).collect()}
    passes = [(s, min(r, quota[s] // have[s]), quota[s] - min(r, quota[s] // have[s]) * have[s] if quota[s] // have[s] < r else 0) for s, (_, r) in active.items() if have.get(s)]
    rule = F.broadcast(spark.createDataFrame(passes, "source string, full int, rest long"))
    # a stretch's texts start within it, so the last may reach over: the extra part ends where the sum would pass the rest
    lined = routed.withColumn("bucket", F.floor(F.col("at") * buckets / F.greatest(F.lit(1), F.lit(max(so_far.values(), default=1)))))
    sums2 = lined.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("here")).withColumn("start", F.sum("here").over(Window.partitionBy("source").orderBy("bucket")) - F.col("here")).select("source", "bucket", "start")
    inner = Window.partitionBy("source", "bucket").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mix = scratch.write(
        lined.withColumn("end", F.sum("n_tokens").over(inner)).join(sums2, ["source", "bucket"]).join(rule, "source")
        .select("doc_id", "source", "n_tokens", (F.col("full") + (F.col("start") + F.col("end") <= F.col("rest")).cast("int")).cast("int").alias("repeats")).filter("repeats > 0")
    )
    per = mix.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("mix_tokens"), F.sum("n_tokens").alias("distinct_tokens"), F.count("*").alias("texts"), F.max("repeats").alias("highest_repeat")
    )
    goal = spark.createDataFrame([(s, w / weights if weights else 0.0, present.get(s, 0.0) / reach if reach else 0.0, quota[s]) for s, w, _ in wanted], "source string, target_share double, reachable_share double, quota_tokens long")
    shares = goal.join(per, "source", "left").na.fill(0, ["mix_tokens", "distinct_tokens", "texts", "highest_repeat"])
    whole = F.sum("mix_tokens").over(Window.partitionBy())
    shares = shares.select(
        "source", "target_share", "reachable_share", F.when(whole > 0, F.col("mix_tokens") / whole).otherwise(0.0).alias("actual_share"), "quota_tokens", "mix_tokens", "distinct_tokens", "texts", "highest_repeat"
    )
    return mix, shares

