"""URL filtering by host and path rules and, where none fits, gradient-boosted trees on lexical features.

Everything runs as DataFrame expressions: parsing, rules, features, the histograms that the trees are grown from,
and the trees themselves, which become one nested conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: (verdict, rule) where a rule is a host suffix and a path prefix.
DEFAULT_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "labels", "path_length", "host_length", "suffix_rate", "suffix_support")
#: Suffixes whose statistics may be broadcast; beyond that the join shuffles.
BROADCAST_SUFFIXES = 10_000
#: Rules that one conditional expression may hold.
EXPRESSION_RULES = 500


def _upper_to_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where :// is missing."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    clean = F.coalesce(url, F.lit(""))
    return _upper_to_lower(F.regexp_extract(clean, pattern, 1)), F.regexp_extract(clean, pattern, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of rules of one length the last by code point wins.

    Up to EXPRESSION_RULES rules are one conditional expression; more are an array that is searched.
    """
    if len(rules) > EXPRESSION_RULES:
        parts = [(len(r), r, v, *r.partition("/")[::2]) for v, r in rules]
        every = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(r).alias("r"), F.lit(v).alias("v"), F.lit(h).alias("h"), F.lit("/" + p).alias("p")) for n, r, v, h, p in parts))
        best = F.array_max(F.filter(every, lambda x: ((host == x["h"]) | host.endswith(F.concat(F.lit("."), x["h"]))) & path.startswith(x["p"])))
        return best["r"], best["v"]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a URL, all doubles."""
    n = F.length(url)
    some = F.greatest(n, F.lit(1)).cast("double")

    def bits(acc: Column, ch: Column) -> Column:
        p = (n - F.length(F.replace(url, ch, F.lit("")))) / some
        return acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "length": n.cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / some,
        "entropy": F.round(F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), bits), 6),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
        "labels": F.when(host == "", 0).otherwise(F.size(F.split(host, r"\."))).cast("double"),
        "path_length": F.length(path).cast("double"),
        "host_length": F.length(host).cast("double"),
    }


@dataclass
class Trees:
    """Boosted oblivious trees: per tree its splits (feature, threshold) by level and its leaf values."""

    base: float = 0.0
    rate: float = 0.3
    trees: list[tuple[list[tuple[int, float]], list[float]]] = field(default_factory=list)

    def margin(self, features: Sequence[Column]) -> Column:
        out = F.lit(self.base)
        for splits, leaves in self.trees:

            def grow(level: int, node: int, splits=splits, leaves=leaves) -> Column:
                if level == len(splits):
                    return F.lit(leaves[node])
                f, t = splits[level]
                return F.when(features[f] > t, grow(level + 1, 2 * node + 1)).otherwise(grow(level + 1, 2 * node))

            out = out + grow(0, 0)
        return out


def fit_trees(rows: DataFrame, features: Sequence[str], label: str = "y", trees: int = 6, depth: int = 3, bins: int = 16, rate: float = 0.3, penalty: float = 1.0) -> Trees:
    """Logistic boosting of oblivious trees. Each level is one aggregation: gradient sums by node, feature and bin."""
    n, positive = rows.agg(F.count(F.lit(1)), F.sum(label)).first()
    model = Trees(rate=rate)
    if not n:
        return model
    p = min(max((positive or 0) / n, 1e-3), 1 - 1e-3)
    model.base = math.log(p / (1 - p))
    if positive in (0, n):
        return model
    cuts = rows.agg(*(F.percentile_approx(f, [(i + 1) / bins for i in range(bins - 1)], 2000).alias(f) for f in features)).first()
    cuts = [sorted(set(cuts[f])) for f in features]
    cols = [F.col(f) for f in features]
    bin_of = F.array(*(sum(((c > t).cast("int") for t in ts), F.lit(0)) for c, ts in zip(cols, cuts, strict=True)))
    binned = rows.withColumn("bins", bin_of)
    for _ in range(trees):
        chance = 1 / (1 + F.exp(-model.margin(cols)))
        graded = binned.withColumn("g", F.col(label) - chance).withColumn("h", chance * (1 - chance))
        splits: list[tuple[int, float]] = []
        for _ in range(depth):
            node = F.lit(0)
            for f, t in splits:
                node = node * 2 + (cols[f] > t).cast("int")
            sums = graded.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("f", "bin")).groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            best, choice = 1e-9, None
            for f, ts in enumerate(cuts):
                own = [r for r in sums if r["f"] == f]
                nodes = {r["node"] for r in own}
                for k, t in enumerate(ts):
                    gain = 0.0
                    for node_id in nodes:
                        lo = [(r["g"], r["h"]) for r in own if r["node"] == node_id and r["bin"] <= k]
                        hi = [(r["g"], r["h"]) for r in own if r["node"] == node_id and r["bin"] > k]
                        gl, hl, gr, hr = sum(x for x, _ in lo), sum(x for _, x in lo), sum(x for x, _ in hi), sum(x for _, x in hi)
                        gain += gl * gl / (hl + penalty) + gr * gr / (hr + penalty) - (gl + gr) ** 2 / (hl + hr + penalty)
                    if gain > best + 1e-9:
                        best, choice = gain, (f, t)
            if choice is None:
                break
            splits.append(choice)
        if not splits:
            break
        node = F.lit(0)
        for f, t in splits:
            node = node * 2 + (cols[f] > t).cast("int")
        leaves = [0.0] * (1 << len(splits))
        for r in graded.groupBy(node.alias("node")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            leaves[r["node"]] = round(rate * r["g"] / (r["h"] + penalty), 9)
        model.trees.append((splits, leaves))
    return model


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = DEFAULT_RULES, id_col: str = "page_id", url_col: str = "url", fit_rows: int = 20_000, trees: int = 6, depth: int = 3) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, method_score (chance of block by the trees).

    The URLs that a rule decides are the labelled ones: block or allow is what the trees learn, from length, depth,
    digit ratio, entropy, parameter counts, host labels and the statistics of the host's last label (share of
    blocked URLs and their number, smoothed, counted over all labelled URLs). The trees are fitted on at most
    fit_rows labelled URLs, those of lowest hash. The rule's verdict wins; the trees decide the rest (block from
    a chance of one half).

    A null URL, or one without ://, has an empty host and path and is judged by its features like any other.
    Without labelled URLs all others are allowed. Repeated rows get equal answers; a null id is carried. An empty table
    gives an empty result. Very long URLs are read whole. Other columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("suffix", F.substring_index("host", ".", -1))
    found = lexical(F.col("url"), F.col("host"), F.col("path"))
    labelled = rows.where(F.col("ruled").isNotNull()).withColumn("y", (F.col("ruled") == "block").cast("double"))
    suffixes = materialize(labelled.groupBy("suffix").agg(F.sum("y").alias("blocked"), F.count(F.lit(1)).alias("n")), "url-suffixes")
    count, blocked, total = suffixes.agg(F.count(F.lit(1)), F.sum("blocked"), F.sum("n")).first()
    prior = (blocked or 0.0) / total if total else 0.0
    rates = suffixes.select(F.col("suffix").alias("of_suffix"), ((F.col("blocked") + 20 * prior) / (F.col("n") + 20)).alias("rate"), F.log2(F.col("n") + F.lit(1)).alias("support"))
    if count <= BROADCAST_SUFFIXES:
        rates = F.broadcast(rates)

    def featured(df: DataFrame) -> DataFrame:
        df = df.select("*", *(c.alias(k) for k, c in found.items())).join(rates, F.col("suffix") == F.col("of_suffix"), "left")
        return df.withColumn("suffix_rate", F.coalesce("rate", F.lit(prior))).withColumn("suffix_support", F.coalesce("support", F.lit(0.0)))

    sample = labelled.select("url", "host", "path", "suffix", "y").orderBy(F.xxhash64("url"), "url").limit(fit_rows)
    train = materialize(featured(sample).select("y", *FEATURES), "url-train")
    model = fit_trees(train, FEATURES, trees=trees, depth=depth)
    scored = featured(rows).withColumn("method_score", F.round(1 / (1 + F.exp(-model.margin([F.col(f) for f in FEATURES]))), 9))
    return scored.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("method_score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "method_score",
    )
