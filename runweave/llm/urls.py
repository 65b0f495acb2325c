"""URL filter: host and path rules first, then a weighted vocabulary found by one Aho-Corasick automaton.

A rule is `host/path`: it fits its host and all subdomains when the path of the URL starts with the rule's; the
longest rule that fits decides. Without one, the vocabulary judges: one strict term rejects, and so do `soft_needed`
distinct soft terms. A term counts where no letter or digit stands beside it.

Null URLs, and those without `://`, have an empty host and path, fit no rule and hold no term: they are allowed.
Repeated rows are judged each on its own, an empty table gives an empty one, further columns pass through unless
they have the name of a result, which then replaces them. Long URLs are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import lower_ascii

STRICT, SOFT = "strict", "soft"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#`, A-Z in lower case; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Mapping[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def automaton_of(vocabulary: Mapping[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for number, (term, kind) in enumerate(vocabulary.items()):
        if kind not in (STRICT, SOFT) or not term:
            raise ValueError(f"a term needs a text and one of the weights {STRICT}, {SOFT}: {term!r}, {kind!r}")
        found.add_word(term, (number, len(term), kind))
    if vocabulary:
        found.make_automaton()
    return found


def count_terms(urls: Iterable[str | None], found: ahocorasick.Automaton) -> Iterable[tuple[int, int]]:
    """Distinct strict and distinct soft terms in each text, which is in lower case."""
    for url in urls:
        hits: dict[str, set[int]] = {STRICT: set(), SOFT: set()}
        if url and len(found):
            for end, (number, size, kind) in found.iter(url):
                before, after = url[end - size: end - size + 1] if end >= size else "", url[end + 1: end + 2]
                if not before.isalnum() and not after.isalnum():
                    hits[kind].add(number)
        yield len(hits[STRICT]), len(hits[SOFT])


def judge_urls(df: DataFrame, rules: Mapping[str, str], vocabulary: Mapping[str, str], url: str = "url",
               soft_needed: int = 2) -> DataFrame:
    """Add `host`, `path`, `rule`, `n_strict`, `n_soft` and `verdict` (allow or block) to each row. No shuffle: the
    rules are column expressions, the vocabulary travels with the function."""
    terms = dict(vocabulary)

    @F.pandas_udf("n_strict int, n_soft int")
    def counted(urls: pd.Series) -> pd.DataFrame:
        found = automaton_of(terms)
        return pd.DataFrame(list(count_terms(urls, found)), columns=["n_strict", "n_soft"])

    kept = [c for c in df.columns if c.lower() not in {"host", "path", "rule", "verdict", "n_strict", "n_soft"} or c == url]
    named = df.select(*[df[c] for c in kept], host_of(df[url]).alias("host"), path_of(df[url]).alias("path"),
                      counted(lower_ascii(df[url])).alias("_hits"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    vocab = F.when((F.col("_hits.n_strict") > 0) | (F.col("_hits.n_soft") >= soft_needed), "block").otherwise("allow")
    return named.select(*kept, "host", "path", rule.alias("rule"), F.col("_hits.n_strict").alias("n_strict"),
                        F.col("_hits.n_soft").alias("n_soft"), F.coalesce(said, vocab).alias("verdict"))


#: The rules of the registered query.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Its vocabulary: one strict term is enough, of the soft ones two distinct.
VOCABULARY = {
    **dict.fromkeys(["porn", "xxx", "casino", "malware", "phishing", "warez", "spam", "viagra", "bets"], STRICT),
    **dict.fromkeys(["free", "ads", "track", "farm", "cheap", "win", "bonus", "click", "adult", "poker", "loans",
                     "pills", "utm_source", "ref"], SOFT),
}


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES, VOCABULARY).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _oracle() -> str:
    def distinct(kind: str) -> str:
        return " + ".join(f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')::INT"
                          for term, weight in VOCABULARY.items() if weight == kind)

    tests = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{rule}'"
        for rule in sorted(RULES, key=len, reverse=True) for h, _, p in [rule.partition("/")])
    said = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for rule, verdict in RULES.items())
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS low,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (SELECT *, CASE {tests} END AS rule, ({distinct(STRICT)})::INT AS n_strict, ({distinct(SOFT)})::INT AS n_soft FROM parts)
SELECT page_id, host, path, rule, n_strict, n_soft,
  coalesce(CASE rule {said} END, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE = {"op1_url_filter": _oracle()}
