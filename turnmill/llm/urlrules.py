"""URL filter rules matched by hashed host-suffix and path-prefix expressions.

A rule names a host and a path prefix and fits its host and all subdomains. Each distinct host and path is expanded into
the expressions a rule could have: its last k labels for every label count among the rules, with the first n characters of
its path for every path length among the rules. Expressions meet rules on four bytes of their digest; the full digest then
confirms. The longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
SMALL_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A to Z lower-cased. Path: then up to ? # or end. Else both empty."""
    has = url.contains("://")
    rest = F.when(has, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _expression(host: Column, path: Column) -> Column:
    # A host holds no slash, so the first one always ends it.
    return F.concat(host, F.lit("/"), path)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict added; columns of these names are replaced.

    ``rules``: host, path, verdict (allow or block). A rule's length is that of its host and path together; where two are
    equally long the longer path, then block, then the smaller text decides. Urls no rule fits, null urls and those
    without :// get rule null and the verdict ``default``. Repeated rows each get their result; an empty table gives none.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url_col))
    parts = pages.withColumn("__host", F.coalesce(host, F.lit(""))).withColumn("__path", F.coalesce(path, F.lit("")))

    known = rules.filter("host is not null and path is not null and verdict is not null and host != ''").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict").distinct()
    shapes = known.select(F.size(F.split("r_host", "[.]")).alias("labels"), F.length("r_path").alias("chars"))
    # At most as many values as a host has labels and a path has characters.
    labels = sorted(r[0] for r in shapes.select("labels").distinct().collect())
    chars = sorted(r[0] for r in shapes.select("chars").distinct().collect())
    digest = F.sha2(_expression(F.col("r_host"), F.col("r_path")), 256)
    keyed = known.select(
        F.substring(digest, 1, 8).alias("short"), digest.alias("full"), F.concat("r_host", "r_path").alias("rule"), "verdict",
        F.struct(
            (F.length("r_host") + F.length("r_path")).alias("length"), F.length("r_path").alias("path"),
            (F.col("verdict") == "block").alias("block")).alias("rank"))
    if keyed.limit(SMALL_RULES + 1).count() <= SMALL_RULES:
        keyed = F.broadcast(keyed)

    places = parts.select("__host", "__path").distinct()
    hosts = F.array_distinct(F.array(*[F.substring_index("__host", ".", -n) for n in labels], F.lit("")))
    paths = F.filter(F.array(*[F.when(F.length("__path") >= n, F.substring("__path", 1, n)) for n in chars], F.lit(None)),
                     lambda p: p.isNotNull())
    spread = places.withColumn("h", F.explode(F.array_remove(hosts, ""))).withColumn("p", F.explode(paths))
    asked = spread.withColumn("asked", F.sha2(_expression(F.col("h"), F.col("p")), 256)).withColumn("short", F.substring("asked", 1, 8))
    fits = asked.join(keyed, "short").filter(F.col("asked") == F.col("full"))
    best = fits.groupBy("__host", "__path").agg(F.min_by(
        F.struct("rule", "verdict"), F.struct(-F.col("rank.length"), -F.col("rank.path"), ~F.col("rank.block"), F.col("rule"))).alias("chosen"))
    found = parts.join(best.select("__host", "__path", "chosen"), ["__host", "__path"], "left")
    return found.select(
        *kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("chosen.rule").alias("rule"),
        F.coalesce("chosen.verdict", F.lit(default)).alias("verdict"))
