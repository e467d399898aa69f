"""Overlap of rotated boxes (cx, cy, dx, dy, yaw), vectorised over pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corners(b: np.ndarray) -> np.ndarray:
    """[n, 4, 2] in counter-clockwise order; the yaw turns a box clockwise."""
    half = np.array([[1, 1], [-1, 1], [-1, -1], [1, -1]]) / 2.0
    local = half[None] * b[:, None, 2:4]
    c, s = np.cos(b[:, 4]), np.sin(b[:, 4])
    x = local[..., 0] * c[:, None] + local[..., 1] * s[:, None] + b[:, None, 0]
    y = local[..., 1] * c[:, None] - local[..., 0] * s[:, None] + b[:, None, 1]
    return np.stack((x, y), axis=2)


def intersection_area(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas of pairwise intersections: box a clipped by the four half-planes of box b, all pairs at once.

    A convex polygon of at most 8 points is kept in fixed-width arrays; each clip keeps points inside, adds crossings,
    and packs the survivors to the front.
    """
    n = len(a)
    width = 10
    poly = np.zeros((n, width, 2))
    poly[:, :4] = corners(a)
    count = np.full(n, 4)
    clip = corners(b)
    rows = np.arange(n)[:, None]
    for e in range(4):
        p, q = clip[:, e], clip[:, (e + 1) % 4]
        edge = q - p
        side = edge[:, None, 0] * (poly[..., 1] - p[:, None, 1]) - edge[:, None, 1] * (poly[..., 0] - p[:, None, 0])
        slot = np.arange(width)[None]
        live = slot < count[:, None]
        after = np.where(slot + 1 < count[:, None], slot + 1, 0)
        side2, poly2 = side[rows, after], poly[rows, after]
        inside, inside2 = side >= 0, side2 >= 0
        t = side / np.where(side == side2, 1.0, side - side2)
        crossing = poly + t[..., None] * (poly2 - poly)
        made = np.concatenate((poly[:, :, None], crossing[:, :, None]), axis=2).reshape(n, 2 * width, 2)
        keep = np.stack((inside & live, (inside != inside2) & live), axis=2).reshape(n, 2 * width)
        order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
        poly, count = made[rows, order], np.minimum(keep.sum(axis=1), width)
    slot = np.arange(width)[None]
    after = np.where(slot + 1 < count[:, None], slot + 1, 0)
    nxt = poly[rows, after]
    cross = np.where(slot < count[:, None], poly[..., 0] * nxt[..., 1] - nxt[..., 0] * poly[..., 1], 0.0)
    return np.where(count >= 3, np.abs(cross.sum(axis=1)) / 2, 0.0)


def overlap(boxes: np.ndarray, queries: np.ndarray, criterion: int = -1) -> np.ndarray:
    """Paired rows. -1: IoU; 0: over the query's area; 1: over the box's area; else the raw area."""
    inter = intersection_area(boxes, queries)
    ab, aq = boxes[:, 2] * boxes[:, 3], queries[:, 2] * queries[:, 3]
    whole = ab + aq - inter if criterion == -1 else aq if criterion == 0 else ab if criterion == 1 else np.ones_like(inter)
    return np.where(whole > 0, inter / np.where(whole > 0, whole, 1), 0.0)


def rotated_overlap(pairs: DataFrame, criterion: int = -1) -> DataFrame:
    """``box_id, query_id, overlap`` of ``box_id, box array<double>, query_id, query array<double>``."""

    def run(frames):
        for pdf in frames:
            b, q = (np.array(pdf[c].tolist(), np.float64).reshape(-1, 5) for c in ("box", "query"))
            yield pd.DataFrame({"box_id": pdf["box_id"], "query_id": pdf["query_id"], "overlap": overlap(b, q, criterion)})

    return pairs.select("box_id", "box", "query_id", "query").mapInPandas(run, "box_id bigint, query_id bigint, overlap double")


def pairs_of(boxes: DataFrame, queries: DataFrame, cell: float) -> DataFrame:
    """Pairs whose circumscribed circles meet (none that overlap is missed), each once.

    A spatial equi-join: a box enters every cell of a grid of side ``cell`` that its circle's square touches; pairs
    meeting in several cells are kept in the first.
    """

    def celled(df, name):
        r = F.sqrt(F.col("box")[2] * F.col("box")[2] + F.col("box")[3] * F.col("box")[3]) / 2
        lo, hi = (lambda i: F.floor((F.col("box")[i] - r) / cell)), (lambda i: F.floor((F.col("box")[i] + r) / cell))
        d = df.select(F.col("id").alias(f"{name}_id"), F.col("box").alias(name), lo(0).alias(f"{name}x"), lo(1).alias(f"{name}y"), F.explode(F.sequence(lo(0), hi(0))).alias("gx"), F.sequence(lo(1), hi(1)).alias("ys"))
        return d.withColumn("gy", F.explode("ys")).drop("ys")

    b, q = celled(boxes, "box"), celled(queries, "query")
    j = b.join(q, ["gx", "gy"])
    span = lambda n: F.sqrt(F.col(n)[2] * F.col(n)[2] + F.col(n)[3] * F.col(n)[3]) / 2
    dx, dy, reach = F.col("box")[0] - F.col("query")[0], F.col("box")[1] - F.col("query")[1], span("box") + span("query")
    return j.where(dx * dx + dy * dy <= reach * reach).where((F.col("gx") == F.greatest("boxx", "queryx")) & (F.col("gy") == F.greatest("boxy", "queryy"))).select("box_id", "box", "query_id", "query")


def axis_aligned_iou(b: Column, q: Column) -> Column:
    """IoU for yaw 0 as an expression."""
    side = lambda i, d: F.greatest(F.least(b[i] + b[d] / 2, q[i] + q[d] / 2) - F.greatest(b[i] - b[d] / 2, q[i] - q[d] / 2), F.lit(0.0))
    inter = side(0, 2) * side(1, 3)
    whole = b[2] * b[3] + q[2] * q[3] - inter
    return F.when(whole > 0, inter / F.when(whole > 0, whole)).otherwise(F.lit(0.0))


#: Pairs compared at once, and the most queries that go to every task.
_PAIRS, MOST_QUERIES = 1 << 18, 1 << 17


def axis_aligned_overlap(boxes: DataFrame, queries: DataFrame) -> DataFrame:
    """``box_id, query_id, overlap`` (IoU, yaw 0) of all pairs ``id, box`` that meet.

    Boxes that crowd in a few cells meet nearly all, so up to ``MOST_QUERIES`` queries go to every task and are compared
    in numpy; more of them meet in :func:`pairs_of`.
    """
    rows = queries.select("id", "box").limit(MOST_QUERIES + 1).toArrow()
    if len(rows) > MOST_QUERIES:
        pairs = pairs_of(boxes, queries, 4.0)
        return pairs.select("box_id", "query_id", axis_aligned_iou(F.col("box"), F.col("query")).alias("overlap")).where("overlap > 0")
    matrix = np.array(rows.column("box").to_pylist(), np.float64).reshape(len(rows), -1)
    shared = boxes.sparkSession.sparkContext.broadcast((rows.column("id").to_numpy(), matrix))

    def run(frames):
        ids, q = shared.value
        for pdf in frames:
            b, b_ids = np.array(pdf["box"].tolist(), np.float64).reshape(len(pdf), -1), pdf["id"].to_numpy()
            step = max(1, _PAIRS // max(1, len(b)))
            for at in range(0, len(q) if len(b) else 0, step):
                x = q[at : at + step, None]
                side = [np.minimum(b[:, i] + b[:, i + 2] / 2, x[..., i] + x[..., i + 2] / 2) - np.maximum(b[:, i] - b[:, i + 2] / 2, x[..., i] - x[..., i + 2] / 2) for i in (0, 1)]
                row, col = np.nonzero((side[0] > 0) & (side[1] > 0))
                inter = side[0][row, col] * side[1][row, col]
                whole = (b[:, 2] * b[:, 3])[col] + (x[:, 0, 2] * x[:, 0, 3])[row] - inter
                yield pd.DataFrame({"box_id": b_ids[col], "query_id": ids[at : at + step][row], "overlap": inter / whole})

    boxes = boxes.select("id", "box")
    return boxes.repartition(boxes.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "box_id bigint, query_id bigint, overlap double")
