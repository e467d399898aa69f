"""Agreement of partitions and structure of graphs, all on contingency tables and degree sums."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, n``."""
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _margins(table: DataFrame):
    return table.groupBy("a").agg(F.sum("n").alias("na")), table.groupBy("b").agg(F.sum("n").alias("nb")), table.agg(F.sum("n").alias("total"))


def nmi(table: DataFrame) -> DataFrame:
    """One row: mutual information over the arithmetic mean of the entropies; 1 for two one-class partitions."""
    ra, rb, t = _margins(table)
    j = table.join(ra, "a").join(rb, "b").crossJoin(F.broadcast(t))
    info = j.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda m, c: m.crossJoin(F.broadcast(t)).agg(F.sum(-F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total"))).alias(f"h{c}"))
    one = info.crossJoin(entropy(ra, "na")).crossJoin(entropy(rb, "nb"))
    half = (F.col("hna") + F.col("hnb")) / 2
    return one.select(F.when(half > 0, F.greatest(F.col("mi"), F.lit(0.0)) / F.when(half > 0, half)).otherwise(F.lit(1.0)).alias("nmi"))


def ari(table: DataFrame) -> DataFrame:
    """One row: adjusted Rand index by pair counts; 1 where both partitions are trivial."""
    ra, rb, t = _margins(table)
    c2 = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    one = table.agg(c2("n").alias("ij")).crossJoin(ra.agg(c2("na").alias("i"))).crossJoin(rb.agg(c2("nb").alias("j"))).crossJoin(t)
    pairs = F.col("total") * (F.col("total") - 1) / 2.0
    expected = F.col("i") * F.col("j") / F.when(pairs > 0, pairs)
    most = (F.col("i") + F.col("j")) / 2
    return one.select(F.when(most - expected != 0, (F.col("ij") - expected) / F.when(most - expected != 0, most - expected)).otherwise(F.lit(1.0)).alias("ari"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: sum over communities of L_c/m - (d_c/2m)^2 for edges ``src, dst`` and ``id, label``."""
    l1, l2 = labels.toDF("i1", "a"), labels.toDF("i2", "b")
    e = edges.join(l1, F.col("src") == F.col("i1")).join(l2, F.col("dst") == F.col("i2")).select("a", "b")
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("c"), (F.col("a") == F.col("b")).cast("long").alias("w")), F.struct(F.col("b").alias("c"), (F.col("a") == F.col("b")).cast("long").alias("w")))).alias("x"))
    per = ends.groupBy("x.c").agg(F.count(F.lit(1)).alias("d"), (F.sum("x.w") / 2.0).alias("inside"))
    m = edges.agg(F.count(F.lit(1)).cast("double").alias("m"))
    terms = per.crossJoin(F.broadcast(m)).where("m > 0").select((F.col("inside") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))).alias("q"))
    return terms.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("modularity"))


#: Graphs of at most so many edges are moved in the driver's memory (about 100 bytes an edge), by the same rule and with
#: the same result as in Spark; larger ones become so when they are contracted.
LOCAL_EDGES = 500_000
_DIGITS = 9


def _turn_of(turn: int, node: int) -> bool:
    return md5(f"{turn}|{node}".encode()).hexdigest() < "8"


def communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, label`` of communities found by modularity: local moves, then the same on the contracted graph (Louvain).

    Deterministic: each turn half of the nodes (by a hash of turn and node) move to the neighbouring community of most
    gain, ties going to their own, then to the smaller label. Turns go on until two in a row move nothing, or modularity
    has not grown for six; the best labels count. Levels go on until contraction changes nothing. A community is named
    by its smallest member.
    """
    spark = edges.sparkSession
    graph = edges.union(edges.select("dst", "src")).toDF("u", "v")
    graph = materialize(graph.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w")), "graph")
    out = nodes.select("id", F.col("id").alias("label"))
    while True:
        if graph.count() <= 2 * LOCAL_EDGES:
            rows = graph.toArrow()  # toPandas() makes objects of all values where a session has Arrow switched off
            member = louvain(*(rows.column(c).to_numpy() for c in ("u", "v", "w")))
            del rows
            known = spark.createDataFrame(pa.table({"su": pa.array(list(member), pa.int64()), "sl": pa.array(list(member.values()), pa.int64())}))
            graph = None
        else:
            known = _moved(graph)
        out = out.join(known, F.col("label") == F.col("su"), "left").select("id", F.coalesce("sl", "label").alias("label"))
        if graph is None or known.where("su <> sl").isEmpty():
            break
        a, b = known.toDF("ua", "la"), known.toDF("ub", "lb")
        graph = materialize(graph.join(a, F.col("u") == F.col("ua")).join(b, F.col("v") == F.col("ub")).groupBy(F.col("la").alias("u"), F.col("lb").alias("v")).agg(F.sum("w").alias("w")), "graph")
        out = materialize(out, "communities")
    least = out.groupBy(F.col("label").alias("l2")).agg(F.min("id").alias("least"))
    return out.join(least, F.col("label") == F.col("l2")).select("id", F.col("least").alias("label"))


class _Watch:
    """When the turns of a level end, and whether the labels just made are the best so far."""

    def __init__(self) -> None:
        self.best, self.quiet, self.since = float("-inf"), 0, 0

    def better(self, quality: float) -> bool:
        grown = quality > self.best + 10.0**-_DIGITS
        self.since = 0 if grown else self.since + 1
        self.best = max(self.best, quality)
        return grown

    def ended(self, moved: bool) -> bool:
        self.quiet = 0 if moved else self.quiet + 1
        return self.quiet == 2 or self.since == 6


def louvain(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> dict[int, int]:
    """Node -> community of symmetric weighted pairs (both directions; a pair of a node with itself once)."""
    member = {int(x): int(x) for x in np.unique(u)}
    while len(u):
        ids, place = np.unique(u, return_inverse=True)
        to = np.searchsorted(ids, v)
        k = np.bincount(place, w)
        total = k.sum()
        label = best = np.arange(len(ids))
        other = place != to
        watch, turn = _Watch(), 0
        watch.better(_quality(place, to, w, label, k, total))
        while True:
            weight = np.bincount(label, k, len(ids))
            who = np.concatenate((place[other], np.arange(len(ids))))
            near = np.concatenate((label[to[other]], label))
            code, which = np.unique(who * len(ids) + near, return_inverse=True)
            pull = np.bincount(which, np.concatenate((w[other], np.zeros(len(ids)))))
            who, near = code // len(ids), code % len(ids)
            own = near == label[who]
            gain = np.round(pull - (weight[near] - np.where(own, k[who], 0.0)) * k[who] / total, _DIGITS)
            order = np.lexsort((near, ~own, -gain, who))
            first = order[np.concatenate(([True], who[order][1:] != who[order][:-1]))]
            mine = np.fromiter((_turn_of(turn, x) for x in ids.tolist()), bool, len(ids))
            new = np.where(mine, near[first], label)
            moved = bool((new != label).any())
            label = new
            if watch.better(_quality(place, to, w, label, k, total)):
                best = label
            turn += 1
            if watch.ended(moved):
                break
        if (best == np.arange(len(ids))).all():
            break
        found = dict(zip(ids.tolist(), ids[best].tolist(), strict=True))
        member = {x: found[c] for x, c in member.items()}
        code, which = np.unique(best[place] * len(ids) + best[to], return_inverse=True)
        w = np.bincount(which, w)
        u, v = ids[code // len(ids)], ids[code % len(ids)]
    return member


def _quality(place, to, w, label, k, total) -> float:
    inside = w[label[place] == label[to]].sum() / total
    return float(inside - ((np.bincount(label, k) / total) ** 2).sum())


def _moved(graph: DataFrame) -> DataFrame:
    """``su, sl``: one level's moves in Spark, every sum a partial aggregation."""
    degree = materialize(graph.groupBy("u").agg(F.sum("w").alias("k")), "degrees")
    total = float(degree.agg(F.sum("k").alias("k")).first()["k"])
    best = labels = materialize(degree.select("u", F.col("u").alias("label"), "k"), "labels")

    def quality(labels):
        a, b = labels.select(F.col("u").alias("ua"), F.col("label").alias("la")), labels.select(F.col("u").alias("ub"), F.col("label").alias("lb"))
        inside = graph.join(a, F.col("u") == F.col("ua")).join(b, F.col("v") == F.col("ub")).where("la = lb").agg(F.sum("w").alias("x")).first()["x"] or 0.0
        squares = labels.groupBy("label").agg(F.sum("k").alias("k")).agg(F.sum(F.pow(F.col("k") / total, F.lit(2))).alias("x")).first()["x"]
        return inside / total - squares

    watch, turn = _Watch(), 0
    watch.better(quality(labels))
    while True:
        sums = labels.groupBy(F.col("label").alias("c")).agg(F.sum("k").alias("weight"))
        near = labels.select(F.col("u").alias("v2"), F.col("label").alias("to"))
        links = graph.where("u <> v").join(near, F.col("v") == F.col("v2")).groupBy("u", "to").agg(F.sum("w").alias("w"))
        stay = labels.select("u", F.col("label").alias("to"), F.lit(0.0).alias("w"))
        offers = links.union(stay).groupBy("u", "to").agg(F.sum("w").alias("w"))
        offers = offers.join(labels.withColumnRenamed("u", "lu"), F.col("u") == F.col("lu")).join(sums, F.col("to") == F.col("c"))
        rest = F.col("weight") - F.when(F.col("to") == F.col("label"), F.col("k")).otherwise(F.lit(0.0))
        gain = F.round(F.col("w") - rest * F.col("k") / F.lit(total), _DIGITS)
        choice = offers.groupBy("u").agg(F.max_by("to", F.struct(gain, F.col("to") == F.col("label"), -F.col("to"))).alias("to"))
        mine = F.md5(F.concat_ws("|", F.lit(str(turn)), F.col("u").cast("string")).cast("binary")) < "8"
        moved = labels.join(choice.withColumnRenamed("u", "bu"), F.col("u") == F.col("bu")).select("u", F.when(mine, F.col("to")).otherwise(F.col("label")).alias("label"), "k", (mine & (F.col("to") != F.col("label"))).alias("moved"))
        moved = materialize(moved, "labels")
        labels = moved.drop("moved")
        if watch.better(quality(labels)):
            best = labels
        turn += 1
        if watch.ended(not moved.where("moved").isEmpty()):
            break
    return best.select(F.col("u").alias("su"), F.col("label").alias("sl"))


def confusion(df: DataFrame, gt: str = "gt", pred: str = "pred", ignore: int = 255) -> DataFrame:
    """``gt, pred, n`` without ignored ground truth; additive over images."""
    return df.where(F.col(gt) != ignore).groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_iou(cm: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, class, iou (NaN where the class is nowhere), present (in the ground truth)."""
    k = list(keys)
    each = F.explode(F.array(F.struct(F.col("gt").alias("c"), F.col("n").alias("row"), F.lit(0).cast("long").alias("col"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("row"), F.col("n").alias("col"), F.lit(0).cast("long").alias("tp"))))
    s = cm.select(*k, each.alias("x")).groupBy(*k, F.col("x.c").alias("class")).agg(F.sum("x.row").alias("row"), F.sum("x.col").alias("col"), F.sum("x.tp").alias("tp"))
    union = F.col("row") + F.col("col") - F.col("tp")
    return s.select(*k, "class", F.when(union > 0, F.col("tp") / F.when(union > 0, union)).otherwise(F.lit(float("nan"))).alias("iou"), (F.col("row") > 0).alias("present"))


def miou(cm: DataFrame, keys: tuple[str, ...] = (), present_only: bool = False) -> DataFrame:
    """keys, miou: mean IoU over classes that are not NaN."""
    iou = class_iou(cm, keys).where(~F.isnan("iou"))
    if present_only:
        iou = iou.where("present")
    return iou.groupBy(*keys).agg(F.avg("iou").alias("miou"))
