"""Squarified treemaps (Bruls, Huizing and van Wijk, 2000): the largest children of each folder as rectangles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.workers import ready
from .rollup import by_size

#: Children of a folder that get a rectangle, and folders that are laid out together.
MOST_ITEMS, FOLDERS = 60, 2_000


def candidates(nodes: DataFrame, most: int = MOST_ITEMS, parent: str | None = None) -> DataFrame:
    """The largest children of each folder (or of one) that have a size, ranked."""
    rows = nodes.where("parent_path IS NOT NULL AND size_bytes > 0")
    if parent is not None:
        rows = rows.where(F.col("parent_path") == parent)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("parent_path").orderBy(*by_size()))).where(F.col("rank") <= most)


def squarify(values: list[float], x: float, y: float, width: float, height: float) -> list[tuple[float, float, float, float]]:
    """(x, y, width, height) of each value, which are positive and fall. Areas add up to the bounds."""
    out: list[tuple[float, float, float, float]] = []
    total = sum(values)
    if not total or width <= 0 or height <= 0:
        return [(x, y, 0.0, 0.0)] * len(values)
    areas = [v * width * height / total for v in values]
    i = 0
    while i < len(areas):
        side = min(width, height)
        if side <= 0:  # rounding has used up the bounds
            out += [(x, y, 0.0, 0.0)] * (len(areas) - i)
            break
        row, worst = 0.0, float("inf")
        j = i
        while j < len(areas):
            grown = row + areas[j]
            ratio = max(side * side * areas[i] / grown**2, grown**2 / (side * side * areas[j]))
            if ratio > worst:
                break
            row, worst, j = grown, ratio, j + 1
        thick, at = row / side, 0.0
        for a in areas[i:j]:
            long = a / thick
            out.append((x, y + at, thick, long) if width >= height else (x + at, y, long, thick))
            at += long
        if width >= height:
            x, width = x + thick, width - thick
        else:
            y, height = y + thick, height - thick
        i = j
    return out


def squarify_many(values: np.ndarray, count: np.ndarray, width: float, height: float) -> np.ndarray:
    """The rectangles of many folders at once, as squarify() gives them one by one: (folders, items, 4).

    values: (folders, items), positive and falling, count of them in each row. All folders take a step together: the next
    item joins the row of rectangles at hand, or the row is closed and the item is tried again in the next one, so there
    are at most two steps an item.
    """
    folders, most = values.shape
    used = np.arange(most)[None, :] < count[:, None]
    total = np.zeros(folders)
    for k in range(most):  # added in the order of the items
        total = total + np.where(used[:, k], values[:, k], 0.0)
    areas = np.where(used, values * width * height / np.where(total > 0, total, 1.0)[:, None], 0.0)
    x, y, w, h = (np.full(folders, float(v)) for v in (0, 0, width, height))
    first, at, row, worst = np.zeros(folders, int), np.zeros(folders, int), np.zeros(folders), np.full(folders, np.inf)
    thick, across = np.zeros((folders, most)), np.zeros((folders, most), bool)
    corner = np.zeros((folders, most, 2))
    left = np.flatnonzero(count > 0)
    while len(left):
        f, j = first[left], np.minimum(at[left], most - 1)
        side = np.minimum(w[left], h[left])
        grown, big, small = row[left] + areas[left, j], areas[left, f], areas[left, j]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.maximum(side * side * big / (grown * grown), grown * grown / (side * side * small))
        grows = (at[left] < count[left]) & (side > 0) & ~(ratio > worst[left])
        g = left[grows]
        row[g], worst[g], at[g] = grown[grows], ratio[grows], at[g] + 1
        c = left[~grows]
        if len(c):
            ok = np.minimum(w[c], h[c]) > 0  # rounding may have used up the bounds: what is left has no area
            t = np.where(ok, row[c] / np.where(ok, np.minimum(w[c], h[c]), 1.0), 0.0)
            at[c] = np.where(ok, at[c], count[c])
            inside = (np.arange(most)[None, :] >= first[c][:, None]) & (np.arange(most)[None, :] < at[c][:, None])
            upright = w[c] >= h[c]
            for target, value in ((thick, t), (across, upright)):
                target[c] = np.where(inside, value[:, None], target[c])
            corner[c] = np.where(inside[:, :, None], np.stack((x[c], y[c]), 1)[:, None, :], corner[c])
            x[c], w[c] = np.where(upright, x[c] + t, x[c]), np.where(upright, w[c] - t, w[c])
            y[c], h[c] = np.where(upright, y[c], y[c] + t), np.where(upright, h[c], h[c] - t)
            first[c], row[c], worst[c] = at[c], 0.0, np.inf
        left = left[first[left] < count[left]]
    with np.errstate(divide="ignore", invalid="ignore"):
        long = np.where(thick > 0, areas / thick, 0.0)
    place, before = np.zeros((folders, most)), np.zeros(folders)
    for k in range(most):
        new = np.ones(folders, bool) if k == 0 else (corner[:, k] != corner[:, k - 1]).any(1)
        before = np.where(new, 0.0, before)
        place[:, k] = before
        before = before + long[:, k]
    out = np.stack((corner[:, :, 0] + np.where(across, 0.0, place), corner[:, :, 1] + np.where(across, place, 0.0), np.where(across, thick, long), np.where(across, long, thick)), 2)
    return out


def layout(items: DataFrame, width: float = 100.0, height: float = 60.0, most: int = MOST_ITEMS) -> DataFrame:
    """parent_path, full_path, rank, size_bytes and the rectangle. items: candidates() of at most `most` a folder, so that
    a folder is one row of short lists; a task lays out all folders of an Arrow batch together."""
    slim = items.groupBy("parent_path").agg(F.sort_array(F.collect_list(F.struct("rank", "full_path", "size_bytes"))).alias("r"))
    slim = slim.select("parent_path", F.col("r.full_path").alias("full_path"), F.col("r.rank").alias("rank"), F.col("r.size_bytes").alias("size_bytes"))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, FOLDERS):
                part = batch.slice(k, FOLDERS)
                lists = [part.column(c) for c in (1, 2, 3)]
                count = np.asarray(lists[0].value_lengths(), int)
                flat = [x.flatten() for x in lists]
                used = np.arange(most)[None, :] < count[:, None]
                values = np.zeros((len(count), most))
                values[used] = flat[2].to_numpy(zero_copy_only=False)
                boxes = squarify_many(values, count, width, height)[used]
                parents = part.column(0).take(pa.array(np.repeat(np.arange(len(count)), count)))
                yield pa.RecordBatch.from_arrays([parents, *flat, *(pa.array(boxes[:, c]) for c in range(4))], ["parent_path", "full_path", "rank", "size_bytes", "x", "y", "width", "height"])

    return ready(slim).mapInArrow(run, "parent_path string, full_path string, rank int, size_bytes bigint, x double, y double, width double, height double")
