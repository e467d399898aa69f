r"""Quality rules by a rule bitmask ledger (operator 9) - DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one ``fail_bits`` integer, bit ``b``
set if rule ``b`` fails. Policies are versioned masks over those bits, so a policy change, a what-if or an ablation is
bitwise arithmetic on the ledger and never touches the texts again.

Everything is row-local: no shuffle, no explode. The repeated three-word windows of a document are found by packing
``hash << bits | position`` into longs, sorting that primitive array, and keeping neighbours with equal hash whose
words are then compared; ``bits`` follows the document's length, so long texts are handled whole.

Defined results: null or empty text has no words: all counts 0, every ratio rule that divides by zero passes, the
base rule (under ``min_words`` words) fails. Repeated rows are judged row by row, so they agree. An empty table gives
an empty ledger. Extra columns never enter (only the id and text columns are read).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``failed`` is a boolean expression over the measurements."""

    name: str
    failed: str


#: Order is the bit position and therefore part of the stored format: append, never reorder.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("odd_word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule("shouting", "n_words > 0 AND 2 * n_shout > n_words"),
    Rule("exclamations", "n_words > 0 AND 2 * n_exclaim > n_words"),
    Rule("one_word_dominates", "n_words >= 50 AND 5 * n_distinct_words < n_words AND n_distinct_words < 40"),
)
BITS = {rule.name: 1 << k for k, rule in enumerate(RULES)}

#: Versioned policies: the rules that reject. Old versions stay, so old decisions can be replayed.
POLICIES = {
    "v1": BITS["few_words"] | BITS["repeated_windows"],
    "v2": BITS["few_words"] | BITS["repeated_windows"] | BITS["duplicate_lines"] | BITS["many_symbols"] | BITS["odd_word_length"] | BITS["shouting"] | BITS["exclamations"] | BITS["one_word_dominates"],
}
CURRENT = "v2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_shout", "n_exclaim")


def _repeat_words() -> tuple[Column, Column, Column]:
    """Expressions, to be evaluated one after the other: sorted codes, positions of repeated windows, covered words."""
    codes = F.expr(
        "CASE WHEN size(__w) >= 4 THEN sort_array(transform(sequence(0, size(__w) - 3), "
        "i -> (shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __b) | CAST(i AS BIGINT)))) "
        "ELSE CAST(array() AS ARRAY<BIGINT>) END"
    )
    same = (
        "(shiftrightunsigned({0}, __b) = shiftrightunsigned({1}, __b) AND "
        "__w[CAST({0} & __m AS INT)] = __w[CAST({1} & __m AS INT)] AND "
        "__w[CAST({0} & __m AS INT) + 1] = __w[CAST({1} & __m AS INT) + 1] AND "
        "__w[CAST({0} & __m AS INT) + 2] = __w[CAST({1} & __m AS INT) + 2])"
    )
    repeated = F.expr(
        "sort_array(transform(filter(__c, (c, j) -> "
        f"(j > 0 AND {same.format('c', '__c[j - 1]')}) OR (j < size(__c) - 1 AND {same.format('c', '__c[j + 1]')})), "
        "c -> CAST(c & __m AS INT)))"
    )
    covered = F.expr(
        "aggregate(__p, named_struct('n', 0L, 'e', 0), "
        "(a, p) -> named_struct('n', a.n + CAST(p + 3 - greatest(p, a.e) AS BIGINT), 'e', p + 3), a -> a.n)"
    )
    return codes, repeated, covered


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, measurements (long), ``fail_bits`` (long). One narrow pass over the texts."""
    codes, repeated, covered = _repeat_words()
    base = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("__t"))
    base = base.withColumn("__w", F.regexp_extract_all("__t", F.lit(f"({WORD})"), F.lit(1)))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD))
    base = base.withColumns(
        {
            "__l": lines,
            # positions need bits; the bit length of the word count is enough for every document
            "__b": F.length(F.bin(F.size("__w").cast("long"))),
        }
    ).withColumn("__m", F.expr("shiftleft(1L, __b) - 1"))
    base = base.withColumn("__c", codes).withColumn("__p", repeated)
    measured = base.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("__t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct_words"),
        F.regexp_count("__t", F.lit(r"(?<![^\x20\x09-\x0D])[A-Z]{2}")).cast("long").alias("n_shout"),
        F.regexp_count("__t", F.lit(r"!+")).cast("long").alias("n_exclaim"),
    )
    bits = " + ".join(f"CASE WHEN {rule.failed} THEN {1 << k}L ELSE 0L END" for k, rule in enumerate(RULES))
    return measured.withColumn("fail_bits", F.expr(bits))


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed. Only bits are read."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and kept if the rule were dropped.

    One aggregation over the ledger: rows meet in one group per distinct bit pattern (at most 2^rules rows), so
    nothing about a rule is ever recomputed.
    """
    mask = POLICIES[policy]
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("__bits")).agg(F.count(F.lit(1)).alias("__n"))
    used = [rule.name for rule in RULES if BITS[rule.name] & mask]
    aggs = []
    for name in used:
        bit = BITS[name]
        aggs += [
            F.sum(F.when(F.col("__bits").bitwiseAND(F.lit(bit)) != 0, F.col("__n")).otherwise(0)).alias(f"f_{name}"),
            F.sum(F.when(F.col("__bits") == bit, F.col("__n")).otherwise(0)).alias(f"a_{name}"),
        ]
    total = patterns.agg(F.sum(F.when(F.col("__bits") == 0, F.col("__n")).otherwise(0)).alias("kept_now"), *aggs)
    rows = ", ".join(f"'{n}', f_{n}, a_{n}" for n in used)
    return total.selectExpr("kept_now", f"stack({len(used)}, {rows}) AS (rule, failed, failed_alone)").selectExpr(
        "rule",
        "coalesce(failed, 0L) AS failed",
        "coalesce(failed_alone, 0L) AS failed_alone",
        "coalesce(kept_now + failed_alone, 0L) AS kept_without",
    )


def digest(docs: DataFrame) -> DataFrame:
    led = apply_policy(ledger(docs))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"),
        "n_lines", "n_distinct_words", "n_shout", "n_exclaim", "fail_bits",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), tok AS (
  SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w
), tri AS (
  SELECT r, i, x AS a, lead(x) OVER (PARTITION BY r ORDER BY i) AS b, lead(x, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM tok
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1
), cov AS (
  SELECT r, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct_words,
         CAST(len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]{2}'))) AS BIGINT) AS n_shout,
         CAST(len(regexp_extract_all(t, '!+')) AS BIGINT) AS n_exclaim
  FROM w LEFT JOIN cov USING (r)
), f AS (
  SELECT *, CAST(
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END +
    CASE WHEN 2 * n_dup_lines > n_lines THEN 4 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END +
    CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END +
    CASE WHEN n_words > 0 AND 2 * n_shout > n_words THEN 32 ELSE 0 END +
    CASE WHEN n_words > 0 AND 2 * n_exclaim > n_words THEN 64 ELSE 0 END +
    CASE WHEN n_words >= 50 AND 5 * n_distinct_words < n_words AND n_distinct_words < 40 THEN 128 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, fail_bits = 0 AS kept,
       n_lines, n_distinct_words, n_shout, n_exclaim, fail_bits
FROM f
"""
