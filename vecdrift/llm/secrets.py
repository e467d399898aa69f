r"""Secret scan over a trigram inverted index (operator 1) - DataFrame functions only.

1. From each rule's regular expression a Boolean query over trigrams is derived (:func:`trigram_query`): a text that
   matches must hold all trigrams of at least one alternative. Rules with no mandatory trigram scan fully.
2. The postings of all trigrams that occur in some query are built in one pass. The index is partitioned by document:
   a posting list is one bit per document, kept beside the document as bit ``t`` of ``postings``
   (:func:`postings`), so intersecting lists is ``AND`` of words and needs no shuffle. :func:`posting_lists` turns
   the same index into rows ``(trigram, id)`` for storing.
3. Documents that pass a rule's query are its candidates; only they meet the regular expression. Spans come from one
   marked replacement per rule: matches are wrapped in two control characters, the text is split at them, and running
   lengths give code-point offsets.

Defined results: null or empty texts have no spans; repeated rows give equal rows; control characters 1 and 2 in a
text are replaced by 3 before marking (no rule matches any of them, lengths stay). An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


@dataclass(frozen=True)
class Rule:
    """``least``: (group, characters) - matches whose group is shorter are dropped after matching."""

    kind: str
    pattern: str
    least: tuple[int, int] = (0, 0)


#: The base rules, then those that the index adds (public token formats). Listed order breaks ties.
BASE = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 8)),
    Rule("access", r"AKIA[A-Z0-9]+", (0, 16)),
    Rule("hex", r"[0-9a-f]+", (0, 32)),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9_.=/+-]{20,}"),
)
RULES = BASE + ADDED

#: A query is a list of alternatives, each a set of lower-case trigrams; ``None`` means that nothing is mandatory.
Query = list[frozenset[str]] | None
_MOST_STRINGS = 64
#: Pieces a block (an even number): a text of n matches takes n * (this + n / this) steps.
_PIECES = 256


def _strings(node) -> set[str] | None:
    """All lower-cased strings that the node matches exactly, or None if they aren't a small finite set."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        found = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                found.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _exact(arg[3])
    if op is sre.BRANCH:
        parts = [_exact(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] == 1 and arg[0] == 0:
        inner = _exact(arg[2])
        return None if inner is None else inner | {""}
    return None


def _exact(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _strings(node)
        if found is None or len(out) * len(found) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in found}
    return out


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams that every match must hold one whole set of; None: no mandatory trigram.

    Runs of nodes with few exact strings are multiplied out; each run gives an OR of ANDs, and of all runs the one
    whose weakest alternative holds most trigrams is taken (any run is mandatory, so one suffices).
    """
    runs, now = [], {""}
    for node in [*sre_parse.parse(pattern), None]:
        found = None if node is None else _strings(node)
        if found is not None and len(now) * len(found) <= _MOST_STRINGS:
            now = {a + b for a in now for b in found}
            continue
        runs.append(now)
        # what repeats at least once may be cut after its first round: its strings begin the rest of the run
        now = found if found is not None else {""}
    best = max(runs, key=lambda run: min(len(_trigrams(x)) for x in run))
    sets = {_trigrams(x) for x in best}
    if any(not s for s in sets):
        return None
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


QUERIES: dict[str, Query] = {rule.kind: trigram_query(rule.pattern) for rule in RULES}
#: Dictionary of the index: every trigram some query asks for; its place is its bit.
TRIGRAMS = sorted({t for q in QUERIES.values() if q for alternative in q for t in alternative})
_WORD_BITS = 63


def postings(lowered: Column, trigrams: list[str] | None = None) -> Column:
    """array<long>: bit ``t % 63`` of word ``t // 63`` is this document's entry in the posting list of trigram t."""
    trigrams = TRIGRAMS if trigrams is None else trigrams
    words = []
    for at in range(0, max(len(trigrams), 1), _WORD_BITS):
        word = F.lit(0).cast("long")
        for k, t in enumerate(trigrams[at : at + _WORD_BITS]):
            word = word.bitwiseOR(F.when(F.contains(lowered, F.lit(t)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return F.array(*words)


def candidate(query: Query, bits: Column, trigrams: list[str] | None = None) -> Column:
    """Whether the intersected postings leave this document a candidate."""
    trigrams = TRIGRAMS if trigrams is None else trigrams
    if query is None:
        return F.lit(True)
    place = {t: k for k, t in enumerate(trigrams)}
    out = F.lit(False)
    for alternative in query:
        masks: dict[int, int] = {}
        for t in alternative:
            masks[place[t] // _WORD_BITS] = masks.get(place[t] // _WORD_BITS, 0) | 1 << place[t] % _WORD_BITS
        hit = F.lit(True)
        for w, m in sorted(masks.items()):
            hit = hit & (bits[w].bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long"))
        out = out | hit
    return out


def posting_lists(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index as rows ``(trigram, doc_id)``, for writing it out partitioned by trigram."""
    bits = docs.select(F.col(id_column).alias("doc_id"), postings(F.lower(text_or_empty(text_column))).alias("__p"))
    names = F.array(*[F.when(bits["__p"][k // _WORD_BITS].bitwiseAND(F.lit(1 << k % _WORD_BITS).cast("long")) != 0, F.lit(t)) for k, t in enumerate(TRIGRAMS)])
    return bits.select("doc_id", F.explode(F.array_compact(names)).alias("trigram"))


def _spans(rule: Rule, kept: Column) -> Column:
    """array<struct<start, kind, end>> of a rule in column ``__t`` (control characters 1 and 2 already replaced)."""
    pattern = rule.pattern
    group, least = rule.least
    if rule.kind in ("access", "hex"):  # maximal runs of one class: the length test can be part of the pattern
        pattern = pattern.removesuffix("+") + "{%d,}" % (least - len("AKIA") * (rule.kind == "access"))
        group = least = 0
    marked = F.regexp_replace("__t", pattern, "\x01$0\x02")
    pieces = F.split(F.when(kept & F.col("__t").rlike(pattern), marked), "[\x01\x02]", -1)
    rank = [r.kind for r in RULES].index(rule.kind)
    enough = "true" if not least else f"char_length(regexp_extract(p, r'{pattern.replace(chr(39), chr(92) + 'x27')}', {group})) >= {least}"
    # pieces alternate: outside, match, outside, ... Offsets add up block by block, so that appending stays cheap.
    # A transform of a one-element array names an intermediate value: a plan that copies the column copies no work.
    spans = "CAST(array() AS ARRAY<STRUCT<s: BIGINT, k: INT, e: BIGINT>>)"
    named = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    blocks = f"transform(sequence(0, (size(ps) - 1) DIV {_PIECES}), b -> slice(ps, b * {_PIECES} + 1, {_PIECES}))"
    sums = "aggregate(x, 0L, (c, p) -> c + CAST(char_length(p) AS BIGINT))"
    begins = (
        "aggregate(bs, named_struct('at', 0L, 'out', CAST(array() AS ARRAY<BIGINT>)), "
        f"(a, x) -> named_struct('at', a.at + {sums}, 'out', concat(a.out, array(a.at))), a -> a.out)"
    )
    fold = (
        f"flatten(transform(bs, (x, b) -> aggregate(x, named_struct('at', os[b], 'i', 0, 'out', {spans}), "
        "(a, p) -> named_struct('at', a.at + CAST(char_length(p) AS BIGINT), 'i', a.i + 1, 'out', "
        f"CASE WHEN a.i % 2 = 1 AND {enough} THEN concat(a.out, array(named_struct('s', a.at, 'k', {rank}, 'e', a.at + CAST(char_length(p) AS BIGINT)))) ELSE a.out END), "
        "a -> a.out)))"
    )
    inner = named("bs", blocks, named("os", begins, fold))
    return pieces, named("ps", "__pieces", f"CASE WHEN ps IS NULL THEN {spans} ELSE {inner} END")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans_by_rule: array<struct<s, k, e>>`` sorted by start, then rule; all rules, every document."""
    df = docs.select(F.col(id_column).alias("doc_id"), F.translate(text_or_empty(text_column), "\x01\x02", "\x03\x03").alias("__t"))
    df = df.withColumn("__bits", postings(F.lower("__t")))
    found = []
    for rule in rules:
        pieces, spans = _spans(rule, candidate(QUERIES[rule.kind], F.col("__bits")))
        name = f"__s_{rule.kind}"
        df = df.withColumn("__pieces", pieces).withColumn(name, F.expr(spans)).drop("__pieces")
        found.append(name)
    return df.select("doc_id", F.array_sort(F.flatten(F.array(*found))).alias("spans"))


def _joined(spans: str, names: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', element_at({names}, x.k + 1), CAST(x.s AS STRING), CAST(x.e AS STRING))), ',')"


def digest(docs: DataFrame) -> DataFrame:
    names = "array(" + ", ".join(f"'{r.kind}'" for r in RULES) + ")"
    base = "filter(spans, x -> x.k < 3)"
    count = "CAST(size(filter(spans, x -> x.k = {})) AS BIGINT)"
    return scan(docs).select(
        "doc_id",
        *[F.expr(count.format(k)).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(F.expr(_joined(base, names)), 256).alias("base_sha256"),
        F.expr(_joined("spans", names)).alias("spans"),
    )


def redact(docs: DataFrame, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every match of a rule replaced in the text; null texts stay null."""
    text = F.col(text_column)
    for rule in RULES:
        group, least = rule.least
        pattern = rule.pattern if not least else rule.pattern.removesuffix("+") + "{%d,}" % (least - len("AKIA") * (rule.kind == "access"))
        text = F.regexp_replace(text, pattern, mask)
    return docs.withColumn(text_column, text)


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rule, end) by Python's re, for tests."""
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.least[0]]) >= rule.least[1]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def _oracle() -> str:
    """The same spans in SQL: matches are marked, texts split at the marks, lengths added up."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for k, rule in enumerate(RULES):
        group, least = rule.least
        pattern = rule.pattern
        enough = f"length(regexp_extract(x, {quote(pattern)}, {group})) >= {least}" if least else "true"
        parts.append(
            f"SELECT r, {k} AS k, s, s + length(x) AS e FROM (SELECT r, p[i] AS x, i, coalesce(list_sum(list_transform(p[1:i - 1], lambda y: length(y))), 0) AS s FROM "
            f"(SELECT r, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT r, string_split_regex(regexp_replace(t, {quote(pattern)}, chr(1) || '\\0' || chr(2), 'g'), '[\x01\x02]') AS p FROM d))) WHERE {enough}"
        )
    names = "[" + ", ".join(quote(r.kind) for r in RULES) + "]"
    item = f"({names})[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"CAST(coalesce(sum(CASE WHEN k = {k} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, {counts}, coalesce(string_agg({item}, ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '') AS base, string_agg({item}, ',' ORDER BY s, k) AS spans FROM m GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


ORACLE_SQL = _oracle()
