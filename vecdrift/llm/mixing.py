r"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 6).

Every document gets an exponential key ``-ln(u) / w``: ``u`` a hash of its id and text in (0, 1), ``w`` its quality
weight. Documents sorted by that key within their source are a weighted sample without replacement, whatever prefix is
taken. A source's target is met by complete epochs (every document once each) and then the longest prefix of that
order whose words fit the rest; then the document of size nearest to the gap left, but within it, enters a few times,
and at last one that may exceed it if that brings the total nearer (sources of few, long documents need this).

Scale: a source may hold a third of all rows, so no task ever holds a source. Each source is dealt into about
``sqrt(n)`` buckets by ``floor(B * exp(-key * w_mean))``-like position of the key; bucket sums (``sqrt(n)`` rows a
source) are prefix-summed, and the order inside a bucket (about ``sqrt(n)`` rows) is a window over (source, bucket).
Texts are read once, for sizes and keys, which are written out; all later steps carry id, key and size only. What is
joined per source is replicated over salts: small, it is broadcast by size; if not, a hot source is still spread. All
DataFrame functions, no Python.

Defined results: null text has size 0 and is taken 0 words; a null source is a source of its own, last in order;
documents of size 0 never move a sum. Repeated rows (same id, same text) have equal keys and are told apart by a row
number, so each counts. If all sizes are 0 every target is 0. An empty table gives an empty result. Extra columns pass
through :func:`mix` untouched. Reruns agree: keys come from content, not from a random generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

#: The repeating weights of sources in code-point order, and the most epochs of a source.
WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3.0
#: How often the gap left by the prefix is closed by the document nearest to it; the last may overshoot.
CLOSING = 4


def words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(column: str = "text") -> Column:
    """A cheap weight in [1, 2] from the text alone: the share of letters and spaces among its characters."""
    text = text_or_empty(column)
    junk = F.char_length(F.regexp_replace(text, r"[\p{L}\x20\x0A,.]+", ""))
    return F.lit(2.0) - junk.cast("double") / F.greatest(F.char_length(text), F.lit(1)).cast("double")


def targets(sources: DataFrame, total: Column | None = None) -> DataFrame:
    """``source, n, source_size`` -> adds ``target``: shares of the total by weight, water-filled under the caps.

    With ratios ``cap / weight`` ascending, the capped sources are a prefix of that order; the level of the rest is
    what remains over the weight that remains. One row a source, so the two global windows are small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), "source")
    order = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = sources.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(MAX_EPOCHS))
    level = level.withColumns({"__total": F.sum("source_size").over(whole).cast("double"), "__all_w": F.sum("__w").over(whole)})
    level = level.withColumns({"__before": F.coalesce(F.sum("__cap").over(order), F.lit(0.0)), "__w_before": F.coalesce(F.sum("__w").over(order), F.lit(0.0))})
    # level if this source and all after it are uncapped; the first source for which it stays below its cap sets it
    level = level.withColumn("__level", (F.col("__total") - F.col("__before")) / (F.col("__all_w") - F.col("__w_before")))
    level = level.withColumn("__open", F.col("__level") * F.col("__w") <= F.col("__cap"))
    level = level.withColumn("__place", F.row_number().over(by_ratio))
    level = level.withColumn("__final", F.min_by("__level", F.when(F.col("__open"), F.col("__place"))).over(whole))
    return level.withColumn("target", F.when(F.col("__total") > 0, F.least(F.col("__cap"), F.col("__final") * F.col("__w"))).otherwise(F.lit(0.0))).drop(
        "__cap", "__total", "__all_w", "__before", "__w_before", "__level", "__open", "__place", "__final", "__w"
    )


def _per_source(rows: DataFrame, stats: DataFrame, columns: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """``rows`` with the columns of ``stats`` (one row a source, null source too)."""
    s = stats.select(F.col("source").alias("__ps"), *columns).withColumn("__pn", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = F.col("source").eqNullSafe(F.col("__ps")) & (F.pmod("__h", F.lit(salts)).cast("int") == F.col("__pn"))
    return rows.join(s, on, how).drop("__ps", "__pn")


def plan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weight: Column | None = None) -> DataFrame:
    """``doc_id, __key2, source, size, source_size, target, epochs, taken`` - one row an input row.

    ``epochs``: how often the document enters the mix. ``weight``: the sampling weight (> 0), default
    :func:`quality_weight`.
    """
    weight = quality_weight(text_column) if weight is None else weight
    h = F.xxhash64(F.col(id_column).cast("string"), F.col(text_column))
    u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    base = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), words(text_column).alias("size"),
        h.alias("__h"), u.alias("__u"), weight.cast("double").alias("__wt"),
    ).withColumn("__key", -F.log("__u") / F.col("__wt"))
    base = materialize(base, "mix-keys")
    stats = targets(base.groupBy("source").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("source_size"), F.avg("__wt").alias("__mean")))
    j = _per_source(base, stats, ["__n", "source_size", "target", "__mean"])
    buckets = F.ceil(F.sqrt("__n")).cast("long")
    # ascending keys from bucket 0 on; any weights work, those near the mean give even buckets
    j = j.withColumn("__bucket", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("__key") * F.col("__mean"))) * buckets), buckets - 1).cast("long"))
    per_bucket = j.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select(F.col("source").alias("__bs"), F.col("__bucket").alias("__bb"), "__before")
    inside = Window.partitionBy("source", "__bucket").orderBy("__key", F.col("doc_id").cast("string"), "__h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumn("__inside", F.sum("size").over(inside))
    j = j.join(per_bucket, F.col("source").eqNullSafe(F.col("__bs")) & (F.col("__bucket") == F.col("__bb")), "inner")
    j = j.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(F.lit(0)).cast("long"))
    j = j.withColumn("__upto", F.col("__before") + F.col("__inside"))
    j = materialize(j.withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size")).drop("__bs", "__bb", "__before", "__inside", "__bucket"), "mix-order")
    fits = (F.col("size") > 0) & (F.col("__upto") <= F.col("__rest"))
    gap = j.groupBy("source").agg((F.first("__rest") - F.coalesce(F.max(F.when(fits, F.col("__upto"))), F.lit(0))).alias("__gap"))
    j = _per_source(j, gap, ["__gap"]).withColumn("__in", fits)
    for turn in range(CLOSING):
        most = F.col("__gap") if turn < CLOSING - 1 else 2 * F.col("__gap")
        near = F.struct(F.abs(F.col("__gap") - F.col("size")).alias("d"), F.col("__key"), F.col("doc_id").cast("string").alias("i"), F.col("__h"), F.col("__upto"), F.col("size").alias("s"))
        last = j.where(~F.col("__in") & (F.col("size") > 0) & (F.col("size") <= most)).groupBy("source").agg(F.min(near).alias("__last"))
        j = _per_source(j, last, ["__last"], "left").withColumns({"__in": F.col("__in") | F.coalesce(near == F.col("__last"), F.lit(False)), "__gap": F.col("__gap") - F.coalesce(F.col("__last.s"), F.lit(0))}).drop("__last")
    j = j.withColumn("epochs", F.col("__epochs") + F.col("__in").cast("long"))
    return j.select("doc_id", "__h", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **columns) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the plan says, with all its columns.

    Repeated rows share id and hash; their plans are summed and each of them carries the same share, so the words
    taken stay those of the plan. The join is on (id, content hash), both spread evenly.
    """
    p = plan(docs, **columns)
    idc, text = columns.get("id_column", "doc_id"), columns.get("text_column", "text")
    p = p.withColumn("__no", F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy(F.desc("epochs")))).where("epochs > 0")
    p = p.select(F.col("doc_id").alias("__vd_id"), F.col("__h").alias("__vd_h"), F.col("__no").alias("__vd_no"), F.col("epochs").alias("__vd_epochs"))
    keyed = docs.withColumn("__vd_hash", F.xxhash64(F.col(idc).cast("string"), F.col(text)))
    # dealt by the hash, which holds the id too, for the row numbers and for the join: texts are shuffled once
    keyed = keyed.repartition("__vd_hash").withColumn("__vd_row", F.row_number().over(Window.partitionBy(idc, "__vd_hash").orderBy(F.lit(1))))
    same = F.coalesce(F.col("__vd_id") == F.col(idc), F.col("__vd_id").isNull() & F.col(idc).isNull()) & (F.col("__vd_no") - F.col("__vd_row") == 0)
    out = keyed.join(p, (F.col("__vd_h") == F.col("__vd_hash")) & same, "inner")
    return out.withColumn("__vd_copy", F.explode(F.sequence(F.lit(1), F.col("__vd_epochs").cast("int")))).select(*[F.col(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")
