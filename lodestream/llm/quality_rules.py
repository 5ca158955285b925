"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once and evaluates every rule once: bit i of ``failed_rules`` is set if
rule i fails. A policy is a named set of rules with a version; ``apply_policy`` is one bitwise AND, and
``ablations`` counts by bitwise aggregation what each rule of a policy alone decides, without looking at
a text again.

Defined results: a null text has no words, lines or symbols, and fails like an empty one. Repeated rows
stay repeated. A column of the input that has the name of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Name and failing condition over the measurements; a rule's bit is its place. Append only: stored masks stay valid.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_flood", "5 * n_symbols > word_chars"),
    ("duplicate_lines", "n_dup_lines > 2 AND 2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules: a document is kept if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("default", 1, tuple(BIT))


def measured(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """docs with the measurements of each whole text."""
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({
        "_w": F.expr(rf"filter(split(_t, '{SPACE.replace(chr(92), chr(92) * 2)}'), w -> w != '')"),
        "_l": F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
    })
    # a window is known by the 64-bit hash of its words' hashes
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.expr("transform(_w, w -> xxhash64(w))"),
    })
    out = out.withColumn("_g", F.expr(f"CASE WHEN n_words >= {window} THEN transform(sequence(1, size(_h) - {window - 1}), i -> xxhash64(slice(_h, i, {window}))) ELSE array() END"))
    # most texts repeat no window; the others sort (window, place) and keep places whose neighbour is equal
    out = out.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_g)) < size(_g) THEN array_sort(transform(_g, (g, i) -> struct(g, i))) END"))
    out = out.withColumn("_p", F.expr("array_sort(transform(filter(_s, (x, i) -> x.g = get(_s, i - 1).g OR x.g = get(_s, i + 1).g), x -> x.i))"))
    covered = f"aggregate(transform(_p, (p, j) -> least({window}, coalesce(get(_p, j + 1) - p, {window}))), 0, (a, b) -> a + b)"
    out = out.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long"))
    # a generator of one row: filters on measurements stay above it, so no condition has the arrays made anew for each element
    names = [*MEASURES, "n_lines"]
    out = out.withColumn("_m", F.explode(F.array(F.struct(*names)))).drop("_t", "_w", "_l", "_h", "_g", "_s", "_p", *names)
    return out.withColumns({n: F.col(f"_m.{n}") for n in names}).drop("_m")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and failed_rules, the bits of the rules that fail."""
    bits = " | ".join(f"CASE WHEN {rule} THEN {1 << i}L ELSE 0L END" for i, (_, rule) in enumerate(RULES))
    return measured(docs, text).withColumn("failed_rules", F.expr(bits))


def apply_policy(table: DataFrame, policy: Policy, into: str = "kept") -> DataFrame:
    """The ledger with a boolean column: no rule of the policy fails."""
    return table.withColumn(into, F.col("failed_rules").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(table: DataFrame, policy: Policy) -> DataFrame:
    """One row a rule of the policy: documents that fail it, that fail it alone (kept without it), and all that the policy drops."""
    own = F.col("failed_rules").bitwiseAND(F.lit(policy.mask))
    counts = table.groupBy(own.alias("mask")).agg(F.count("*").alias("n"))  # at most one row a set of bits
    rules = table.sparkSession.createDataFrame([(r, BIT[r]) for r in policy.rules], "rule string, bit long")
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    return (
        rules.join(F.broadcast(counts), hit, "left")
        .groupBy("rule", "bit")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        )
    )


def oracle() -> str:
    """DuckDB SQL for op5."""
    s = r"'[\x20\x09-\x0D]+'"
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), {s}), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
m AS (
  SELECT doc_id, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(l) AS n_lines,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM t),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM m WHERE n_words >= 8)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d WHERE c > 1) GROUP BY doc_id),
f AS (
  SELECT m.*, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT ({' OR '.join(f'({rule})' for _, rule in RULES)}) AS kept
FROM f"""
