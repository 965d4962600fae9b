"""URL filters: one trie over reversed host labels and path segments, longest match first.

The trie is a small nested dict. Its rules come as a Python list whose length is checked against max_rules, so what is
sent to the tasks has a bound; a longer list is refused with a hint to use rules_table(), which joins on keys instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 200_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"


def build(rules: Iterable[Rule]) -> dict:
    """A node holds host labels under "h", path segments under "p", open last segments under "o" and their greatest length under "n".

    A rule's path ends at a segment ("/en/"), or in the middle of one ("/en"), which then is a prefix of any segment.
    Of two rules with the same host and path the first counts.
    """
    root: dict = {}
    for rule in rules:
        node = root
        for label in reversed(rule.host.lower().split(".")) if rule.host else ():
            node = node.setdefault("h", {}).setdefault(label, {})
        *whole, last = rule.path.split("/")
        for segment in whole:
            node = node.setdefault("p", {}).setdefault(segment, {})
        node.setdefault("o", {}).setdefault(last, rule)
        node["n"] = max(len(last), node.get("n", 0))
    return root


def match(trie: dict, host: str, path: str) -> Rule | None:
    """The fitting rule with the most host labels, then the longest path."""
    best, node, labels = None, trie, host.split(".") if host else []
    segments = path.split("/")
    for label in [None, *reversed(labels)]:
        if label is not None:
            node = node.get("h", {}).get(label)
            if node is None:
                break
        at, found = node, None
        for segment in segments:
            for cut in range(min(len(segment), at.get("n", -1)), -1, -1):  # an open last segment, the longest prefix that a rule has first
                if (rule := at.get("o", {}).get(segment[:cut])) is not None:
                    found = rule
                    break
            at = at.get("p", {}).get(segment)
            if at is None:
                break
        best = found or best
    return best


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", key: str = "page_id", url: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """key, host, path, rule, verdict for each row of pages; other columns are not read.

    A rule fits its host and all subdomains if the path starts with the rule's. Where none fits, rule is null and the
    verdict is `default`. Null, empty and malformed urls have an empty host and path; only a rule with an empty host and
    an empty path fits them. Repeated rows each give a row. A path of any length is walked once, with no more prefixes of a
    segment than the longest rule has.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are broadcast, use rules_table()")
    sent = pages.sparkSession.sparkContext.broadcast(build(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = sent.value
        for hosts, paths in parts:
            found = [match(trie, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r and r.host + r.path for r in found], "verdict": [r.verdict if r else default for r in found]})

    out = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return out.withColumn("judged", judged("host", "path")).select(key, "host", "path", "judged.rule", "judged.verdict")


def rules_table(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """As filter_urls, for rules (verdict, host, path) of any number whose paths end in /: distinct urls' trie keys are joined.

    Each distinct (host, path) gives one key for each pair of a host suffix and a path prefix, and keeps its longest match.
    """
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = parts.select("host", "path").distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffix = F.expr("transform(sequence(1, size(labels)), i -> struct(i as depth, array_join(slice(labels, -i, i), '.') as rule_host))")
    prefix = F.expr("transform(sequence(1, size(segments)), i -> array_join(slice(segments, 1, i), '/') || '/')")
    keys = urls.withColumns({"labels": labels, "segments": segments}).withColumn("s", F.explode(suffix)).withColumn("rule_path", F.explode(prefix))
    keys = keys.select("host", "path", "s.depth", "s.rule_host", "rule_path").where(F.col("path").startswith(F.col("rule_path")))
    ruled = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("said"))
    best = keys.join(ruled, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(F.struct("depth", F.length("rule_path").alias("n"), F.concat("rule_host", "rule_path").alias("rule"), "said")).alias("b"))
    return parts.join(best, ["host", "path"], "left").select(key, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.said", F.lit(default)).alias("verdict"))
