"""Filter of urls by a tree of path templates for each host, learnt from labelled urls.

Paths are split into segments, runs of digits become `#`. From the host down, each node of the tree generalises its
variable segments: where a node has more than `most` different children, those with less than the share `rare` of its urls
become `*`. Then branches that look alike are merged: branches of one node are taken by size, and each joins the first
earlier one with the same prevailing label (blocked, allowed, or none) whose next segments are distributed alike, by the
total variation distance, with an allowance for few urls. A path's template is the way through that tree.

A template is rejected by its labelled purity, (blocked + 1) / (blocked + allowed + 2), at `purity` and more. So a
template without labels stays, and few labels do not decide. Segments from the eighth on count as one.

Urls without `://` and null urls have an empty host and an empty path. Such urls are a host of their own. Repeated rows
count as often as they are given. Labels other than block and allow are none. Empty tables give no rows; other
columns come through.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.session import stable

DEEPEST = 8


def with_host_and_path(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds `host` (A-Z in lower case) and `path`."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.locate("://", url)
    after = F.substr(url, at + 3)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumns({
        "host": F.when(at > 0, lower).otherwise(""), "path": F.when(at > 0, path).otherwise(""),
    })


def apply_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds `rule`, the longest of the rules (text, verdict) that fits host and path, and `label`, its verdict. A
    rule's text is a host and the start of a path; it fits the host and its subdomains."""
    def fits(rule: str) -> Column:
        host, path = rule[:rule.index("/")], rule[rule.index("/"):]
        return ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(
            F.col("path"), F.lit(path)
        )

    rule, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule, label = F.when(fits(text), text).otherwise(rule), F.when(fits(text), verdict).otherwise(label)
    return urls.withColumns({"rule": rule, "label": label})


def shape(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def _merge_branches(alike: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Which branch of its node each branch joins, from the counts of their next segments."""
    def merged(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index="token", columns="kind", values="n", aggfunc="sum", fill_value=0)
        sizes = wide.sum(axis=1)
        shares = wide.div(sizes, axis=0)
        labels = part.groupby("token")[["blocked", "allowed", "n"]].sum()
        none = labels["n"] - labels["blocked"] - labels["allowed"]
        prevails = pd.concat([none, labels["allowed"], labels["blocked"]], axis=1).to_numpy().argmax(axis=1)
        prevails = dict(zip(labels.index, prevails, strict=True))
        leaders, joins = [], {}
        for token in sorted(wide.index, key=lambda t: (-sizes[t], t)):
            allowance = alike + sizes[token] ** -0.5
            joins[token] = next((
                x for x in leaders
                if prevails[x] == prevails[token] and (shares.loc[x] - shares.loc[token]).abs().sum() / 2 <= allowance
            ), token)
            if joins[token] == token:
                leaders.append(token)
        return pd.DataFrame({
            "host": part["host"].iloc[0], "template": part["template"].iloc[0], "token": list(joins),
            "branch": list(joins.values()),
        })

    return merged


def templates(shapes: DataFrame, most: int, rare: float, alike: float) -> DataFrame:
    """(host, shape, n, blocked, allowed) with the template of each shape."""
    segments = F.split(F.regexp_replace("shape", "^/", ""), "/", DEEPEST)
    paths = stable(shapes.withColumn("segments", segments).withColumn("template", F.lit("")))
    deepest = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(deepest):
        token = F.get("segments", F.lit(level))
        here = paths.where(token.isNotNull()).withColumn("token", token)
        children = stable(here.groupBy("host", "template", "token").agg(F.sum("n").alias("n")))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("many"), F.sum("n").alias("total"))
        wild = (F.col("many") > most) & (F.col("n") < rare * F.col("total"))
        general = children.join(nodes, ["host", "template"]).select(
            "host", "template", F.col("token").alias("given"), F.when(wild, "*").otherwise(F.col("token")).alias("token")
        )
        following = F.coalesce(F.get("segments", F.lit(level + 1)), F.lit("/"))
        kind = F.substring(F.regexp_replace(following, r"[^#./_-]+", "w"), 1, 8)
        named = stable(
            here.withColumnRenamed("token", "given").join(general, ["host", "template", "given"])
            .withColumn("kind", kind)
        )
        counts = named.groupBy("host", "template", "token", "kind").agg(
            F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")
        )  # a node keeps at most `most` + 1 / `rare` branches, each with a few kinds
        branches = counts.groupBy("host", "template").applyInPandas(
            _merge_branches(alike), "host string, template string, token string, branch string"
        )
        deeper = named.join(branches, ["host", "template", "token"]).withColumn(
            "template", F.concat("template", F.lit("/"), "branch")
        )
        paths = stable(deeper.select(paths.columns).unionAll(paths.where(token.isNull())))
    return paths.drop("segments")


def judge(
    urls: DataFrame, most: int = 12, rare: float = 0.02, alike: float = 0.2, purity: float = 0.8
) -> DataFrame:
    """`urls` (with `host`, `path` and `label`) with `template`, `template_purity` and `rejected`."""
    columns = [c for c in urls.columns if c not in ("template", "template_purity", "rejected")]
    shapes = urls.select("host", shape(F.col("path")).alias("shape"), "label").groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked"),
        F.count(F.when(F.col("label") == "allow", 1)).alias("allowed"),
    )
    known = templates(shapes, most, rare, alike)
    pure = known.groupBy("host", "template").agg(
        ((F.sum("blocked") + 1) / (F.sum("blocked") + F.sum("allowed") + 2)).alias("template_purity")
    )
    known = known.join(pure, ["host", "template"]).select("host", "shape", "template", "template_purity")
    return (
        urls.withColumn("shape", shape(F.col("path"))).join(known, ["host", "shape"])
        .withColumn("rejected", F.col("template_purity") >= purity)
        .select(*[f"`{c}`" for c in columns], "template", "template_purity", "rejected")
    )
