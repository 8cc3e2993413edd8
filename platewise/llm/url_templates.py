"""URL filter by a tree of path templates per host.

Paths are cut at "/". Level by level, each node of a host's tree keeps a child as a branch of its own only if enough
pages share the segment; rarer segments (numbers, ids, titles) become the wildcard ``*``. Kept branches whose share of
blocked pages doesn't differ significantly from the rest of their node's are merged into the wildcard too. Labels are the
pages that a rule decides. A template's purity is its share of blocked pages among labelled ones, smoothed towards its
parent's, which goes back over the host and the host's last label to all pages; templates at or above
``block_at`` are rejected. Paths may be of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.session import stage

#: (verdict, rule), as a rule list states them.
Rules = Sequence[tuple[str, str]]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. The rule list is part of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _smoothed(df: DataFrame, keys: list[str], parent: Column, weight: float, name: str) -> DataFrame:
    """df's rows summed by ``keys``: keys and ``name``, the blocked share smoothed towards ``parent``."""
    sums = df.groupBy(*keys).agg(F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b"), F.first(parent).alias("_p"))
    return sums.select(*keys, ((F.col("_b") + weight * F.col("_p")) / (F.col("_l") + weight)).alias(name))


def _finished(rows: DataFrame, level: int, weight: float) -> DataFrame:
    """Rows of nodes that have fewer than ``min_pages`` pages: every further segment is a wildcard, at any depth.

    Each level down smooths the share of the pages that go as deep; a node has few paths, so their counts fit in a list.
    """
    left = F.size("_segments") - level
    some = rows.groupBy("host", "template").agg(F.collect_list(F.struct(left.alias("r"), "labelled", "blocked")).alias("_deep"))

    def total(name: str, depth: Column) -> Column:
        deep = F.filter("_deep", lambda x: x["r"] >= depth)
        return F.aggregate(deep, F.lit(0).cast("long"), lambda acc, x: acc + x[name])

    purity = F.aggregate(
        F.sequence(F.lit(1), left), F.col("purity"),
        lambda p, depth: (total("blocked", depth) + weight * p) / (total("labelled", depth) + weight),
    )
    out = rows.join(some, ["host", "template"])
    return out.select("host", "path", F.concat("template", F.repeat(F.lit("/*"), left)).alias("template"), purity.alias("purity"))


def template_tree(
    paths: DataFrame, min_pages: int = 20, z: float = 1.96, weight: float = 4.0, depth: int | None = None
) -> DataFrame:
    """host, path, template, purity for the rows of ``paths`` (host, path, n, labelled, blocked; one row per host and path).

    Levels go on as long as some node has ``min_pages`` pages to part; smaller nodes are finished in one step. With a
    ``depth``, segments from that number on form one last segment. Where nothing is labelled at all, purity is 0.
    """
    whole = paths.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    base = F.lit(float(whole["b"] / whole["l"]) if whole["l"] else 0.0)
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", depth or -1)
    rows = paths.withColumn("_zone", F.element_at(F.split("host", r"\."), -1)).withColumn("_segments", segments)
    zones = _smoothed(rows, ["_zone"], base, weight, "_zone_purity")
    rows = rows.join(zones, "_zone")
    hosts = _smoothed(rows, ["host"], F.col("_zone_purity"), weight, "purity")
    rows = rows.join(hosts, "host").select("host", "path", "n", "labelled", "blocked", "_segments", F.lit("").alias("template"), "purity")
    rows, done, level = stage(rows, "url_paths"), [], 0
    while True:
        here = F.size("_segments") > level
        done.append(rows.where(~here).select("host", "path", "template", "purity"))
        rows = rows.where(here)
        node = rows.groupBy("host", "template").agg(*[F.sum(c).alias(f"_{c}") for c in ("n", "labelled", "blocked")])
        node = stage(node, "url_nodes")
        large = F.col("_n") >= min_pages
        small = rows.join(node.where(~large).select("host", "template"), ["host", "template"], "left_semi")
        done.append(_finished(small, level, weight))
        if node.where(large).isEmpty():
            break
        rows = rows.join(node.where(large), ["host", "template"]).withColumn("_segment", F.get("_segments", F.lit(level)))
        child = rows.groupBy("host", "template", "_segment", "_labelled", "_blocked").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        rest_l, rest_b = F.col("_labelled") - F.col("labelled"), F.col("_blocked") - F.col("blocked")
        # Two shares, with one page of each kind added to both sides.
        p, q = (F.col("blocked") + 1) / (F.col("labelled") + 2), (rest_b + 1) / (rest_l + 2)
        pooled = (F.col("_blocked") + 2) / (F.col("_labelled") + 4)
        spread = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("labelled") + 2) + 1 / (rest_l + 2)))
        kept = child.where((F.col("n") >= min_pages) & (F.abs(p - q) > z * spread))
        kept = stage(kept.select("host", "template", "_segment", F.lit(True).alias("_kept")), "url_branches")
        rows = rows.join(kept, ["host", "template", "_segment"], "left")
        step = F.concat("template", F.lit("/"), F.when(F.col("_kept"), F.col("_segment")).otherwise("*"))
        rows = rows.withColumn("template", step).select("host", "path", "n", "labelled", "blocked", "_segments", "template", "purity")
        rows = stage(rows, "url_paths")
        own = _smoothed(rows, ["host", "template"], F.col("purity"), weight, "_own").withColumnRenamed("_own", "purity")
        rows = rows.drop("purity").join(own, ["host", "template"])
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def judge_urls(pages: DataFrame, rules: Rules, block_at: float = 0.5, **tree) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages`` (page_id, url).

    A null url, or one without "://", has an empty host and path and is judged like any other. Rows that repeat each have
    their own row; each counts. Of rules equal in text the last one given holds. Other columns are ignored. An empty table gives no rows. Pages are counted per host and
    path before anything else, so a hot host costs only its distinct paths.
    """
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = read.withColumn("rule", rule).withColumn("_verdict", verdict)
    # A rule depends on host and path alone, so all rows of a path agree.
    paths = ruled.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_verdict").alias("labelled"),
        F.count(F.when(F.col("_verdict") == "block", 1)).alias("blocked"),
    )
    judged = template_tree(stage(paths, "url_counts"), **tree)
    out = ruled.join(judged, ["host", "path"])
    own = F.when(F.col("purity") >= block_at, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", own).alias("verdict"), "template", "purity")
