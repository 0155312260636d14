"""Folder trees with rolled-up figures, and their squarified layout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.scores import SEVERITIES, severity_rank
from quarry.scratch import Scratch


def folder_rollup(files: DataFrame, group: str) -> DataFrame:
    """group, path, parent, depth, is_file and figures of every file and folder; the root has path ''.

    Needs path, sloc, total_lines, total_cc, max_cc, issues, top_severity. Sums and maxima in one aggregation over
    path prefixes, which combines before the shuffle.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    level = files.select(group, F.posexplode(prefixes).alias("depth", "node"), F.size(parts).alias("deepest"), "sloc", "total_lines", "total_cc", "max_cc", "issues", severity_rank(F.col("top_severity")).alias("sev"))
    out = level.groupBy(group, "node", "depth").agg(
        F.max(F.when(F.col("depth") == F.col("deepest"), 1).otherwise(0)).alias("leaf"), F.count("*").alias("file_count"), F.sum("sloc").cast("long").alias("sloc"), F.sum("total_lines").cast("long").alias("total_lines"),
        F.sum("total_cc").cast("long").alias("total_cc"), F.max("max_cc").alias("max_cc"), F.sum("issues").cast("long").alias("issues"), F.min("sev").alias("sev"),
    )
    name = F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("sev"))
    parent = F.when(F.col("depth") > 0, F.regexp_replace("node", r"/?[^/]*$", ""))
    w = Window.partitionBy(group, "parent").orderBy(F.desc("sloc"), "path")
    rows = out.select(group, F.col("node").alias("path"), parent.alias("parent"), "depth", (F.col("leaf") == 1).alias("is_file"), "file_count", "sloc", "total_lines", "total_cc", "max_cc", "issues", name.alias("dominant_severity"))
    return rows.withColumn("position", F.when(F.col("depth") > 0, F.row_number().over(w)).otherwise(0))


def nested_means(rows: DataFrame, scores: DataFrame, group: str) -> DataFrame:
    """``rows`` with maintainability: of folders the mean of their children weighted by files, rounded to one decimal
    at every level, from the deepest level up. ``scores``: group, path, score of files."""
    scratch = Scratch(rows.sparkSession, "treemap")
    rows = scratch.write(rows)
    deepest = rows.agg(F.max("depth")).first()[0]
    base = rows.join(scores.select(group, "path", "score"), [group, "path"], "left")
    done = scratch.write(base.filter("is_file").select(group, "path", "parent", "depth", "file_count", F.coalesce("score", F.lit(100.0)).alias("maintainability")))
    for depth in range((deepest or 0) - 1, -1, -1):
        below = done.filter(F.col("depth") == depth + 1).groupBy(group, F.col("parent").alias("path")).agg(F.round(F.sum(F.col("maintainability") * F.col("file_count")) / F.sum("file_count"), 1).alias("maintainability"))
        up = rows.filter((F.col("depth") == depth) & ~F.col("is_file")).join(below, [group, "path"]).select(group, "path", "parent", "depth", "file_count", "maintainability")
        done = scratch.write(done.unionByName(up))
    return rows.join(done.select(group, "path", "maintainability"), [group, "path"], "left")


def squarify(weights: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles with areas in proportion to ``weights`` (given in falling order), rows of near squares."""
    total = sum(weights)
    if not weights or total <= 0 or w <= 0 or h <= 0:
        return [(x, y, 0.0, 0.0)] * len(weights)
    areas = [v * w * h / total for v in weights]
    out: list[tuple[float, float, float, float]] = []
    i = 0
    while i < len(areas):
        side = min(w, h)
        j, s, worst = i, 0.0, float("inf")
        while j < len(areas):
            t = s + areas[j]
            ratio = max(side * side * areas[i] / (t * t), t * t / (side * side * areas[j]))
            if ratio > worst:
                break
            s, worst, j = t, ratio, j + 1
        thick, at = s / side, 0.0
        for a in areas[i:j]:
            long = a / thick
            out.append((x, y + at, thick, long) if w >= h else (x + at, y, long, thick))
            at += long
        if w >= h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        i = j
    return out


def layout(rows: DataFrame, group: str, width: float = 1000.0, height: float = 1000.0) -> DataFrame:
    """group, path, x, y, w, h (four decimals): each folder's rectangle divided among its children, one group a task.

    The rows of a group are its files and folders, as many as one repository may have (``discovery.MAX_FILES``).
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        children: dict = {}
        for r in part.sort_values(["sloc", "path"], ascending=[False, True]).itertuples(index=False):
            children.setdefault(r.parent, []).append(r)
        boxes = {"": (0.0, 0.0, width, height)}
        stack, out = [""], []
        while stack:
            p = stack.pop()
            kids = children.get(p, [])
            for r, box in zip(kids, squarify([max(1e-6, float(k.sloc or 0)) for k in kids], *boxes[p])):
                boxes[r.path] = box
                stack.append(r.path)
        key = part[group].iloc[0]
        out = [(key, p, *[round(v, 4) for v in box]) for p, box in boxes.items()]
        return pd.DataFrame(out, columns=[group, "path", "x", "y", "w", "h"])

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, "path", "parent", "sloc").groupBy(group).applyInPandas(one, f"{group} {kind}, path string, x double, y double, w double, h double")
