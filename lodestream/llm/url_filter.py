"""URL filter: host/path rules, then a weighted vocabulary found by an Aho-Corasick scan.

A term counts only where neither neighbour is a letter or digit. Every strict term weighs as much as
the threshold, so one rejects; soft terms weigh half of it, so two distinct ones reject. A term that
occurs often counts once.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and is scanned
like any other text (null: no hits, so it is allowed). Repeated rows stay repeated. Further columns of
the input are kept, but one with the name of a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path); the longest host + path that fits decides.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
STRICT = ("casino", "escort", "hentai", "jackpot", "malware", "nsfw", "phishing", "porn", "porno", "torrent", "viagra", "warez", "xxx")
SOFT = ("adult", "ads", "affiliate", "bet", "betting", "cam", "click", "coupon", "crack", "dating", "feed", "free", "keygen", "loan", "poker", "promo", "sex", "slots", "spam", "sponsored", "track", "tracker")
THRESHOLD = 1.0


def vocabulary(strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, threshold: float = THRESHOLD) -> dict[str, float]:
    """Weights by term."""
    return {t: threshold / 2 for t in soft} | {t: threshold for t in strict}


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to / ? # or the end, A-Z lower-cased) and path (then up to ? # or the end)."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict, or nulls. A rule's host fits its subdomains too."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def vocabulary_score(url: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the distinct terms that stand between boundaries in the url."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in weights:
            automaton.add_word(term, term)
        if weights:
            automaton.make_automaton()

        def one(text: str | None) -> float:
            if not text or not weights:
                return 0.0
            hits = set()
            for end, term in automaton.iter(text):
                start = end + 1 - len(term)
                if not (start and _alnum(text[start - 1])) and not (end + 1 < len(text) and _alnum(text[end + 1])):
                    hits.add(term)
            return float(sum(weights[t] for t in hits))

        for urls in batches:
            yield pd.Series([one(u) for u in urls.astype(object).where(urls.notna(), None)], dtype="float64")

    return score(F.translate(url, UPPER, LOWER))


def _alnum(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, weights: dict[str, float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """pages with host, path, rule, verdict (block or allow) and url_score."""
    weights = vocabulary() if weights is None else weights
    host, path = url_parts(F.col(url))
    own = pages.drop(*({"host", "path", "rule", "verdict", "url_score"} - {url}))
    parts = own.withColumns({"host": host, "path": path, "url_score": vocabulary_score(F.col(url), weights)})
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("url_score") >= threshold, "block").otherwise("allow")
    return parts.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)})


def oracle(pages: str = "pages") -> str:
    """DuckDB SQL with the same rules and vocabulary, by one regular expression a term."""
    def hits(terms: tuple[str, ...]) -> str:
        return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)" for t in terms)

    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, what) for what, h, p in ordered]
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM {pages})
SELECT page_id, host, path,
       CASE {' '.join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)} END AS rule,
       CASE {' '.join(f"WHEN {f} THEN '{w}'" for f, _, w in fits)}
            WHEN ({hits(STRICT)}) >= 1 OR ({hits(SOFT)}) >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""
