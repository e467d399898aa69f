r"""Line dedup by overlapping three-line windows (operator 2) - DataFrame functions only.

Lines with a word (split at ``\n``) are numbered within their document. Every window of three consecutive such lines
is hashed to 128 bits; a window that occurs more than once anywhere keeps its first occurrence in the order
(doc_id, content hash, position), and every line covered by a later occurrence is removed.

Shuffles carry (hash, document key, position), never lines: one partial aggregation finds the first place of each
window - a window in a third of all documents is one row per map task there - and one join marks the others. The join's
sides are both plain scans of written tables, so the skew handling of adaptive execution can split a hot window. The
texts are shuffled once, to meet their covered positions.

Defined results: null text has no lines and stays null; lines without a word are never windows' members and stay as
they are; documents with fewer than three worded lines lose nothing. Rows that repeat an id and text are one document
with one result. A null doc_id sorts before all others. An empty table gives an empty result. Extra columns are kept
by :func:`dedup` and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

WINDOW = 3


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = text_or_empty(text_column)
    return docs.withColumns({"__vd_id": F.col(id_column), "__vd_h": F.xxhash64(text), "__vd_g": F.xxhash64(F.lit(1), text)})


def covered_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``__c_id, __c_h, __c_g, covered``: per document with a repeated window, the removed line numbers (from 0, ascending)."""
    keyed = _keyed(docs, id_column, text_column).select("__vd_id", "__vd_h", "__vd_g", text_or_empty(text_column).alias("__t"))
    lines = keyed.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD))).where(F.size("__l") >= WINDOW).drop("__t")
    windows = lines.withColumn(
        "__x",
        F.explode(F.expr(f"transform(sequence(0, size(__l) - {WINDOW}), i -> named_struct('p', i, 'a', xxhash64(__l[i], __l[i + 1], __l[i + 2]), 'b', xxhash64(7, __l[i], __l[i + 1], __l[i + 2])))")),
    ).select("__vd_id", "__vd_h", "__vd_g", F.col("__x.p").alias("p"), F.col("__x.a").alias("a"), F.col("__x.b").alias("b"))
    windows = materialize(windows, "windows")
    place = F.struct(F.col("__vd_id").isNotNull().alias("n"), F.col("__vd_id").alias("i"), F.col("__vd_h").alias("h"), F.col("__vd_g").alias("g"), F.col("p").alias("p"))
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    first = materialize(first, "repeated")
    later = windows.join(first.withColumnsRenamed({"a": "a2", "b": "b2"}), (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "inner").where(place != F.col("first"))
    lost = later.groupBy("__vd_id", "__vd_h", "__vd_g").agg(F.collect_set("p").alias("__p"))
    spread = F.array_sort(F.array_distinct(F.flatten(F.transform("__p", lambda p: F.sequence(p, p + F.lit(WINDOW - 1))))))
    return lost.select(F.col("__vd_id").alias("__c_id"), F.col("__vd_h").alias("__c_h"), F.col("__vd_g").alias("__c_g"), spread.alias("covered"))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the text less its covered lines, plus ``__vd_n_lines``, ``__vd_n_removed``, ``__vd_n_runs``."""
    keyed = _keyed(docs, id_column, text_column)
    covered = covered_lines(docs, id_column, text_column)
    j = keyed.join(covered, F.col("__vd_id").eqNullSafe(F.col("__c_id")) & (F.col("__vd_h") == F.col("__c_h")) & (F.col("__vd_g") == F.col("__c_g")), "left")
    j = j.withColumn("__vd_lines", F.split(text_or_empty(text_column), "\n", -1))
    worded = F.size(F.filter("__vd_lines", lambda x: x.rlike(WORD)))
    # line numbers less those of the covered worded lines: every step is linear in the lines
    numbers = "sequence(0, size(__vd_lines) - 1)"
    j = j.withColumn("__vd_worded", F.when(F.col("covered").isNotNull(), F.expr(f"filter({numbers}, i -> __vd_lines[i] RLIKE r'{WORD}')")))
    j = j.withColumn("__vd_stay", F.expr(f"array_except({numbers}, transform(covered, c -> __vd_worded[c]))"))
    kept = F.expr("array_join(transform(__vd_stay, i -> __vd_lines[i]), '\n')")
    runs = F.expr("size(filter(covered, (p, i) -> i = 0 OR covered[i - 1] <> p - 1))")
    return j.select(
        *[F.when(F.col("covered").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_column else F.col(c) for c in docs.columns],
        worded.cast("long").alias("__vd_n_lines"),
        F.when(F.col("covered").isNull(), F.lit(0)).otherwise(F.size("covered")).cast("long").alias("__vd_n_removed"),
        F.when(F.col("covered").isNull(), F.lit(0)).otherwise(runs).cast("long").alias("__vd_n_runs"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", F.col("__vd_n_lines").alias("n_lines"), F.col("__vd_n_removed").alias("n_removed"), F.col("__vd_n_runs").alias("n_runs"),
        F.sha2(text_or_empty("text"), 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT doc_id, t, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM d
), w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) - 1 AS p,
         lead(x) OVER (PARTITION BY doc_id, t ORDER BY i) AS x2, lead(x, 2) OVER (PARTITION BY doc_id, t ORDER BY i) AS x3
  FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), r AS (
  SELECT doc_id, t, p, row_number() OVER (PARTITION BY x, x2, x3 ORDER BY doc_id NULLS FIRST, p) AS k FROM w WHERE x3 IS NOT NULL
), c AS (
  SELECT DISTINCT doc_id, t, p + o AS p FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1
), k AS (
  SELECT l.doc_id, l.t, l.i, l.x, w.p, c.p AS gone
  FROM l LEFT JOIN w ON l.doc_id IS NOT DISTINCT FROM w.doc_id AND l.t = w.t AND l.i = w.i
         LEFT JOIN c ON w.doc_id IS NOT DISTINCT FROM c.doc_id AND w.t = c.t AND w.p = c.p
), g AS (
  SELECT doc_id, t, count(p) AS n_lines, count(gone) AS n_removed,
         coalesce(string_agg(CASE WHEN gone IS NULL THEN x END, chr(10) ORDER BY i), '') AS kept FROM k GROUP BY doc_id, t
), n AS (
  SELECT doc_id, t, count(*) AS n_runs FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id, t ORDER BY p) AS q FROM c) WHERE q IS NULL OR q <> p - 1 GROUP BY doc_id, t
)
SELECT o.doc_id, CAST(g.n_lines AS BIGINT) AS n_lines, CAST(g.n_removed AS BIGINT) AS n_removed,
       CAST(coalesce(n.n_runs, 0) AS BIGINT) AS n_runs, sha256(g.kept) AS kept_sha256
FROM documents o JOIN g ON o.doc_id IS NOT DISTINCT FROM g.doc_id AND coalesce(o.text, '') = g.t
     LEFT JOIN n ON g.doc_id IS NOT DISTINCT FROM n.doc_id AND g.t = n.t
"""
