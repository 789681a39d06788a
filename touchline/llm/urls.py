"""URL filters: rules by host and path, block decisions passed on over redirects and canonical links.

A rule fits its host and all subdomains if the url's path starts with the
rule's path; of several that fit the longest (host and path together) decides,
and a block wins between equally long ones. A url without a rule takes the
decision of its component: pages that redirect to each other or name each other
as canonical are aliases. If any alias has an explicit allow, the url is
allowed; else if any has an explicit block, it is blocked; else it is allowed.

Edges come from each page's html: every ``<link rel="canonical" href=...>`` and
every ``<meta http-equiv="refresh" content="...url=...">``. ``&amp;`` and the other
common references are undone, and targets are resolved against the page's own
url: with a scheme, without one (``//host``), from the root, relative, a query alone.
Dot segments are taken out. Urls are compared without fragment and with scheme
and host in lower case; targets of other kinds (``mailto:``) make no edge. Components run over urls that have edges only, distributed, and
nothing is sent to the driver but counts.

Helper columns begin with ``url_filter_``; such names are taken.

Null urls and urls without ``://`` have empty host and path, no rule and no
aliases, and are allowed. Null html has no edges. Repeated rows are judged row
by row; an empty table gives an empty result; extra columns pass through and
columns called like the results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import saved
from .components import components

CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]*)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECISION, NODE, BLOCKED = "url_filter_decision", "url_filter_node", "url_filter_blocked"

Rule = tuple[str, str, str]  # allow or block, host, path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for urls without ``://``."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(F.regexp_extract(after, r"(?s)^[^/?#]*(.*)$", 1), r"^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def normal(url: Column) -> Column:
    """Url without fragment, scheme and host in lower case; null without ``://``."""
    head = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*", 0)
    rest = F.regexp_extract(url, r"(?s)^[^/?#]*://[^/?#]*([^#]*)", 1)
    return F.when(head != "", F.concat(F.translate(head, UPPER, LOWER), rest))


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with host, path, rule and ``DECISION`` (null without a rule)."""
    host, path = parts(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2]))

    def fits(rule: Rule) -> Column:
        return ((F.col("host") == rule[1]) | F.col("host").endswith("." + rule[1])) & F.col("path").startswith(rule[2])

    def choose(values: list[str]) -> Column:
        cases = reduce(lambda c, x: c.when(fits(x[0]), F.lit(x[1])), zip(ordered, values, strict=True), F)
        return cases if values else F.lit(None).cast("string")

    return out.withColumn("rule", choose([h + p for _, h, p in ordered])).withColumn(DECISION, choose([a for a, _, _ in ordered]))


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; those that would leave the root are dropped."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    closed = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """The normal url that ``target`` means on the page ``base`` (a normal url); null if it names none."""
    site, scheme = F.regexp_extract(base, r"^[^/?#]*://[^/?#]*", 0), F.regexp_extract(base, r"^[^/?#]*:", 0)
    page = F.regexp_extract(base, r"^([^/?#]*://[^?#]*)", 1)  # without query
    folder = F.when(page.rlike(r"://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_extract(page, r"^(.*/)", 1))
    whole = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(target.contains("://"), target))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(page, target))
        .when((target == "") | target.startswith("#"), base)
        .otherwise(F.concat(folder, target))
    )
    return tidy(normal(whole))


def tidy(url: Column) -> Column:
    """A normal url without dot segments in its path."""
    head = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*", 0)
    path = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*([^?#]*)", 1)
    return F.concat(head, without_dots(path), F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1))


def unescaped(target: Column) -> Column:
    for name, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&")):
        target = F.replace(target, F.lit(name), F.lit(sign))
    return F.trim(target)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): normal urls of pages and of all that they redirect to or call canonical."""
    url = normal(F.col("url"))
    linked = pages.where(url.isNotNull() & F.col("html").isNotNull()).where(F.col("html").rlike(r"(?i)canonical|refresh"))
    found = F.concat(F.regexp_extract_all("html", F.lit(CANONICAL), F.lit(1)), F.regexp_extract_all("html", F.lit(REFRESH), F.lit(1)))
    targets = linked.select(tidy(url).alias("u"), F.explode(found).alias("target"))
    return targets.select("u", resolved(F.col("u"), unescaped(F.col("target"))).alias("v")).where("v IS NOT NULL AND u <> v").distinct()


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block)."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = with_rule(pages.select(*kept), rules)
    edges = saved(alias_edges(pages))
    if edges.isEmpty():
        return judged.select(*kept, "host", "path", "rule", F.coalesce(DECISION, F.lit("allow")).alias("verdict"))
    groups = saved(components(edges, "u", "v"))
    # targets that are no pages decide by their own url too
    named = with_rule(groups.select(F.col("node").alias("url"), "root"), rules)
    decided = named.groupBy("root").agg(F.max(F.col(DECISION) == "allow").alias("allow"), F.max(F.col(DECISION) == "block").alias("block"))
    passed = groups.join(decided, "root").where(F.coalesce(F.col("block"), F.lit(False)) & ~F.coalesce(F.col("allow"), F.lit(False)))
    passed = saved(passed.select(F.col("node").alias(BLOCKED)))
    marked = judged.withColumn(NODE, tidy(normal(F.col("url")))).join(passed, F.col(NODE) == F.col(BLOCKED), "left")
    verdict = F.coalesce(DECISION, F.when(F.col(BLOCKED).isNotNull(), F.lit("block")), F.lit("allow"))
    return marked.select(*kept, "host", "path", "rule", verdict.alias("verdict"))
