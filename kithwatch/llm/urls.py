"""URL filtering: rules on hosts and paths, and boosted trees for what no rule decides.

A rule names a host and the beginning of a path; it fits that host and its subdomains, and
the longest fitting rule wins. The trees see lexical features of a URL only: lengths, depth,
share of digits, entropy of the host's letters, numbers of parameters, words and hyphens, and
how often URLs with the same last label of the host are blocked by a rule. They learn from the
URLs that rules decide: statistics over all of them, trees on at most about ``sample`` rows
chosen by a hash.

Defined results: a null URL, or one without ``://``, has an empty host and path; a URL without
a path fits no rule; without labelled URLs, or with labels of one kind, the trees say that
kind (``allow`` if there are none). Repeated rows are judged one by one. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithwatch.llm.boosting import Boosted, fit

# What is allowed or blocked, by host and path.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
FEATURES = [
    "url_length",
    "host_length",
    "path_length",
    "labels",
    "depth",
    "digit_share",
    "entropy",
    "parameters",
    "hyphens",
    "secure",
    "fragment",
    "longest_label",
    "suffix_blocked",
]
SAMPLE = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: dict[str, str]) -> Column:
    """The longest rule that fits columns ``host`` and ``path``, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda text: (len(text), text)):
        name, slash, rest = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _lexical() -> dict[str, Column]:
    url = F.coalesce("url", F.lit(""))
    letters = F.regexp_replace("host", "[^a-z0-9]", "")
    size = F.greatest(F.length(letters), F.lit(1))
    parts = [F.length(F.regexp_replace(letters, f"[^{c}]", "")) / size for c in _LOWER + "0123456789"]
    entropy = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in parts), F.lit(0.0))
    count = lambda pattern, of: F.regexp_count(of, F.lit(pattern))
    return {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "labels": count("[.]", F.col("host")),
        "depth": count("/", F.col("path")),
        "digit_share": count("[0-9]", url) / F.greatest(F.length(url), F.lit(1)),
        "entropy": entropy,
        "parameters": count("[?&][^=&#]*=", url),
        "hyphens": count("-", F.col("host")),
        "secure": url.startswith("https").cast("int"),
        "fragment": url.contains("#").cast("int"),
        "longest_label": F.array_max(F.transform(F.split("host", "[.]"), F.length)),
    }


def _with_features(parsed: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    rate = F.coalesce((F.col("_blocked") + 5 * prior) / (F.col("_all") + 5), F.lit(prior))
    joined = parsed.withColumn("_suffix", F.substring_index("host", ".", -1)).join(suffixes, "_suffix", "left")
    lexical = {name: column.cast("double") for name, column in _lexical().items()}
    return joined.withColumns({**lexical, "suffix_blocked": rate})


def judge_urls(pages: DataFrame, rules: dict[str, str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``(page_id, host, path, rule, verdict, probability)``; the last is the trees' for a block."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("rule", fitting_rule(rules))
    decided = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        decided = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(decided)
    parsed = parsed.withColumn("decided", decided)
    labelled = parsed.where("decided is not null").withColumn("label", (F.col("decided") == "block").cast("int"))
    suffixes = (
        labelled.groupBy(F.substring_index("host", ".", -1).alias("_suffix"))
        .agg(F.count(F.lit(1)).alias("_all"), F.sum("label").alias("_blocked"))
    )
    known = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    if known["n"]:
        prior = known["blocked"] / known["n"]
        drawn = F.pmod(F.xxhash64(F.lit(8), "url", "page_id"), F.lit(1 << 30)) / float(1 << 30)
        chosen = _with_features(labelled.where(drawn < min(1.0, sample / known["n"])), suffixes, prior)
        # About ``sample`` rows, whatever the size of the table.
        rows = chosen.select("label", *FEATURES, F.xxhash64("url", "page_id").alias("_at")).collect()
        rows.sort(key=lambda row: (row["_at"], row["label"]))
        matrix = np.array([[row[name] for name in FEATURES] for row in rows], float).reshape(len(rows), len(FEATURES))
        model = fit(FEATURES, matrix, np.array([row["label"] for row in rows]))
    else:
        prior, model = 0.0, Boosted(list(FEATURES), start=-10.0)
    judged = _with_features(parsed, suffixes, prior).withColumn("probability", model.probability())
    guess = F.when(F.col("probability") > model.threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("decided", guess).alias("verdict"), "probability")
