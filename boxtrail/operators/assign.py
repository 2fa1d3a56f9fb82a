"""One-to-one assignment of detections to tracks, by picture: greedy as a fold over sorted pairs, optimal in NumPy."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = ("stream_id", "frame_id")


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a least-cost assignment of the rows of a matrix to its columns (or the other way round, if there
    are fewer columns), by shortest augmenting paths."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    if not n:
        return []
    first = c.argmin(1)
    if len(np.unique(first)) == n:  # every row has its least cost to itself: nothing is cheaper
        return sorted((int(j), i) if turned else (i, int(j)) for i, j in enumerate(first))
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        dist, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while True:
            done[j0] = True
            i0 = owner[j0]
            open_ = np.flatnonzero(~done[1:]) + 1
            new = c[i0 - 1, open_ - 1] - u[i0] - v[open_]
            better = new < dist[open_]
            dist[open_[better]], way[open_[better]] = new[better], j0
            j1 = open_[np.argmin(dist[open_])]
            step = dist[j1]
            u[owner[done]] += step
            v[done] -= step
            dist[open_] -= step
            j0 = int(j1)
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = int(way[j0])
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def greedy(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs below most by rising cost, ties by row, then column."""
    i, j = np.nonzero(cost < most)
    rows, cols, out = set(), set(), []
    for k in np.lexsort((j, i, cost[i, j])):
        a, b = int(i[k]), int(j[k])
        if a not in rows and b not in cols:
            rows.add(a)
            cols.add(b)
            out.append((a, b))
    return sorted(out)


def solve(cost: np.ndarray, most: float, method: str = "min") -> list[tuple[int, int]]:
    """min: least cost of whole thousandths, pairs up to most. greedy: see there. auto: greedy where fewer than a quarter
    of the pairs are below most, else min. reference: as auto, with the greatest cost in place of the least."""
    if not cost.size:
        return []
    if method == "greedy" or (method in ("auto", "reference") and (cost < most).sum() < cost.size // 4):
        return greedy(cost, most)
    whole = np.where(cost <= most, np.trunc(cost * 1000), 1_000_000.0)
    return [(a, b) for a, b in least_cost(-whole if method == "reference" else whole) if np.trunc(cost[a, b] * 1000) <= np.trunc(most * 1000)]


def greedy_pairs(pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Of (stream_id, frame_id, l_id, r_id, iou): the greedy one-to-one pairs above threshold, best first, ties by ids."""
    row = F.struct((-F.col("iou")).alias("order"), "l_id", "r_id", "iou")
    groups = pairs.where(F.col("iou") > threshold).groupBy(*FRAME).agg(F.array_sort(F.collect_list(row)).alias("all"))
    empty = F.filter("all", lambda _: F.lit(False))
    taken = lambda acc, x: F.exists(acc, lambda k: (k["l_id"] == x["l_id"]) | (k["r_id"] == x["r_id"]))
    kept = F.aggregate("all", empty, lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return groups.select(*FRAME, F.explode(kept).alias("k")).select(*FRAME, "k.l_id", "k.r_id", "k.iou")


def best_pairs(pairs: DataFrame, threshold: float = 0.3, method: str = "min") -> DataFrame:
    """The same with an optimal assignment of cost 1 - iou; pairs hold every pair of a picture that overlaps. Pictures
    come sorted, many to a batch, so a picture costs no call of its own."""

    def solved(left: np.ndarray, right: np.ndarray, iou: np.ndarray) -> list[tuple[int, int, float]]:
        a, i = np.unique(left, return_inverse=True)
        b, j = np.unique(right, return_inverse=True)
        near = np.zeros((len(a), len(b)))
        near[i, j] = iou
        cost = np.where(near > threshold, 1 - near, 1.0)
        return [(int(a[x]), int(b[y]), near[x, y]) for x, y in solve(cost, 1 - threshold, method) if near[x, y] > threshold]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] | None = None

        def finish(columns: list[np.ndarray], to: int) -> pd.DataFrame:
            stream, frame, left, right, iou = columns
            cut = [0, *(np.flatnonzero((np.diff(stream[:to]) != 0) | (np.diff(frame[:to]) != 0)) + 1).tolist(), to]
            out = [(stream[a], frame[a], *x) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a for x in solved(left[a:b], right[a:b], iou[a:b])]
            return pd.DataFrame(out, columns=["stream_id", "frame_id", "l_id", "r_id", "iou"])

        for batch in batches:
            columns = [batch[c].to_numpy() for c in ("stream_id", "frame_id", "l_id", "r_id", "iou")]
            columns = columns if kept is None else [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            last = np.flatnonzero((columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]))[0]  # a picture that may go on
            if last:
                yield finish(columns, int(last))
            kept = [c[last:] for c in columns]
        if kept is not None:
            yield finish(kept, len(kept[0]))

    ordered = pairs.select(*FRAME, "l_id", "r_id", "iou").repartition(*FRAME).sortWithinPartitions(*FRAME, "l_id", "r_id")
    return ordered.mapInPandas(run, "stream_id long, frame_id long, l_id long, r_id long, iou double")


def total_cost(pairs: DataFrame) -> DataFrame:
    """By picture: the number of assigned pairs and their total cost, in whole thousandths of 1 - iou as the assignment counts them."""
    thousandths = F.floor((1 - F.col("iou")) * 1000)
    return pairs.groupBy(*FRAME).agg(F.count("*").alias("n_pairs"), (F.sum(thousandths) / 1000).alias("cost"))


def assigned(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (detections, side l) with the r_id and iou that they are assigned, null where none is: an assignment as a vector."""
    return rows.join(pairs.withColumnRenamed("l_id", "det_id"), [*FRAME, "det_id"], "left")


def unassigned(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Detections (side l) or tracks (side r) that no pair holds."""
    return rows.join(pairs.select(*FRAME, F.col(f"{side}_id").alias("det_id")), [*FRAME, "det_id"], "left_anti")
