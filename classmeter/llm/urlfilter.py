"""URL filters: explicit rules, and association rules mined by FP-growth for the rest.

A URL becomes a set of tokens (scheme, top-level domain, domain, host words,
first path segment, shapes of all others, extension, query keys, anchor). The
URLs that explicit rules judge are the labelled ones: their tokens and their
verdict are transactions for Spark's FP-growth. Rules `tokens -> verdict` stay
if their support and confidence are high enough. Token sets of the other URLs
are matched by an inverted index: the tokens of a set are joined with the rules
that have them, and a rule fires if all its tokens were met.

All steps are DataFrame and SQL functions. Equal token sets are matched once,
however many pages have them. The number of mined rules is bounded by the
support, not by the number of pages or by the place in a path; it can double
with each further token that frequent URLs have in common.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from classmeter.llm.common import saved

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Scheme, host, path, query and anchor of a URL.
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def host(url: Column) -> Column:
    """What follows the first ://, up to a slash, question mark, number sign or the end, A-Z in lower case.
    Null URLs and those without :// have an empty host and path."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 2), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def explicit(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of `rules` (verdict, host/path) that fits, as a struct of rule and verdict, or null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Of rules as long as each other one that blocks wins, then the first by code point.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", [-ord(c) for c in r[1]])):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit("/" + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """The different tokens of a URL in order; none for a null URL or one without ://."""
    labels = F.split(host(url), r"\.")
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    last = F.try_element_at(segments, F.lit(-1))
    query = F.filter(F.split(F.regexp_extract(url, _PARTS, 4), "&"), lambda s: s != "")

    def tag(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(name + ":"), v))

    def shape(s: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(s, r"[0-9]+", "0"), r"\.[^.]*$", "")

    words = F.filter(F.flatten(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: F.split(x, "[-_]"))), lambda w: w != "")
    every = F.concat(
        tag("scheme", F.array(F.lower(F.regexp_extract(url, _PARTS, 1)))),
        tag("tld", F.slice(labels, -1, 1)),
        F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("domain:"), F.concat_ws(".", F.slice(labels, -2, 2))))).otherwise(F.array().cast("array<string>")),
        tag("word", words),
        tag("first", F.slice(segments, 1, 1)),
        tag("shape", F.transform(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), shape)),
        tag("ext", F.filter(F.array(F.regexp_extract(F.coalesce(last, F.lit("")), r"\.([A-Za-z0-9]{1,5})$", 1)), lambda e: e != "")),
        tag("query", F.transform(query, lambda q: F.regexp_extract(q, "^[^=]*", 0))),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("anchor"))).otherwise(F.array().cast("array<string>")),
    )
    whole = F.regexp_extract(url, _PARTS, 0) != ""
    return F.when(F.coalesce(whole, F.lit(False)), F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, antecedent, verdict, confidence, support) from (tokens, verdict); no rows from no rows."""
    schema = "rule_id long, antecedent array<string>, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return labelled.sparkSession.createDataFrame([], schema)
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.size("consequent") == 1).withColumn("to", F.element_at("consequent", 1))
    found = found.where(F.startswith("to", F.lit("verdict=")) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("verdict="))))
    ordered = F.array_sort("antecedent")
    return found.select(
        F.xxhash64(ordered, "to").alias("rule_id"),
        ordered.alias("antecedent"),
        F.substring("to", 9, 100).alias("verdict"),
        "confidence",
        "support",
    )


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict) for each different token set of `sets` on which a rule fires.

    Of several the most confident wins, then the best supported, then the
    longest, then one that blocks.
    """
    index = rules.select(F.explode("antecedent").alias("token"), "rule_id", F.size("antecedent").alias("needed"), "confidence", "support", (F.col("verdict") == "block").alias("block"))
    each = sets.select("tokens").distinct().withColumn("token", F.explode("tokens"))
    met = each.join(index, "token").groupBy("tokens", "rule_id", "needed", "confidence", "support", "block").agg(F.count(F.lit(1)).alias("n"))
    fired = met.where("n = needed").groupBy("tokens").agg(F.max(F.struct("confidence", "support", "needed", "block")).alias("best"))
    return fired.select("tokens", F.when(F.col("best.block"), "block").otherwise("allow").alias("mined"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    otherwise: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """One row per row of `pages`: its id, host, path, rule (null if none fits) and verdict.

    The verdict is the explicit rule's, else that of the mined rule that fires,
    else `otherwise` (also for null URLs and those without ://). Null ids and
    repeated rows stay. Other columns are not read.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    rows = rows.withColumn("own", explicit(F.col("host"), F.col("path"), rules))
    rows = saved(rows.select("id", "host", "path", "tokens", "own.rule", "own.verdict"), "urls")
    mined = saved(mine(rows.where("verdict IS NOT NULL").select("tokens", "verdict"), min_support, min_confidence), "url-rules")
    # Written, so that the join deals both sides anew and Spark can split a set that many pages have.
    verdicts = saved(matched(rows.where("verdict IS NULL"), mined), "url-verdicts")
    out = rows.join(verdicts, "tokens", "left")
    verdict = F.coalesce("verdict", "mined", F.lit(otherwise))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
