"""URL filters with redirect equivalence (operator 7).

A page takes the longest rule that fits its host and path. The others follow their aliases: pages of one normal form of the url, and those
that redirects or canonical links join, are one component; an allowed alias keeps the whole component, else a blocked one blocks it.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_fitting(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """value(rule) of the longest rule that fits (allow before block in a tie), else null. A short list of literals, not a table."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(value(r))).otherwise(out)
    return out


def normal_form(url: Column) -> Column:
    """What aliases of one page share: no scheme, www. or m., end slash, index or .html, fragment, campaign or referrer parameter. Null without ://."""
    host = F.regexp_replace(host_of(url), r"^(?:(?:www|m)\.)+", "")
    path = F.regexp_replace(path_of(url), r"(?:/index)?(?:\.html?)?/*$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: ~x.rlike(r"^(?:utm_\w+|ref)(?:=|$)") & (x != ""))), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.lit("?"), kept))


def _target(html: Column) -> Column:
    """The address that a page redirects to or names as canonical."""
    canonical = F.regexp_extract(html, r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(html, r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    low = F.lower(html)
    found = F.concat_ws(" ", F.when(low.contains("canonical"), canonical), F.when(low.contains("refresh"), refresh))
    return F.filter(F.split(found, " "), lambda x: x != "")


def _absolute(link: Column, url: Column) -> Column:
    """The link resolved against the page's url by RFC 3986, &amp; decoded; null for other schemes. A base element isn't read."""
    link = F.regexp_replace(link, r"(?i)&(?:amp|#38|#x26);", "&")
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path, tail = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    parts = F.split(F.regexp_replace(whole, r"/(\.\.?)$", "/$1/"), "/")
    up = lambda seen: F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(1)))
    step = lambda seen, x: F.when(x == ".", seen).when(x == "..", up(seen)).otherwise(F.concat(seen, F.array(x)))
    resolved = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("#"), url)
        .when(link.startswith("?"), F.concat(root, path_of(url), link))
        .otherwise(F.concat(root, resolved, tail))
    )


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict and alias_of (its component) for each row.

    A null url, or one without ://, has empty host and path, no aliases and is allowed. A null html has no links. Repeated rows get a row each
    and a null page_id is passed on; other columns aren't read. An empty table gives an empty result.
    """
    url = F.col("url")
    seen = cut(
        pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), normal_form(url).alias("form"), F.transform(_target(F.col("html")), lambda x: _absolute(x, url)).alias("links"))
    )
    fit = lambda value: _first_fitting(F.col("host"), F.col("path"), rules, value)
    ruled = seen.withColumn("rule", fit(lambda r: r.name)).withColumn("given", fit(lambda r: r.verdict))
    links = seen.where("form is not null").select("form", F.explode("links").alias("link")).where("link is not null")
    edges = links.select(F.col("form").alias("u"), normal_form(F.col("link")).alias("v"))
    found = cut(components(edges))
    # verdicts of pages, and of link targets that no page has
    targets = links.select(normal_form(F.col("link")).alias("form"), host_of(F.col("link")).alias("host"), path_of(F.col("link")).alias("path")).withColumn("given", fit(lambda r: r.verdict))
    given = ruled.select("form", "given").union(targets.select("form", "given")).where("form is not null and given is not null").distinct()
    labelled = given.join(found, given.form == found.node, "left").select(F.coalesce("label", "form").alias("label"), "given")
    by_label = labelled.groupBy("label").agg(F.when(F.bool_or(F.col("given") == "allow"), "allow").otherwise("block").alias("inherited"))
    pages_labelled = ruled.join(found, ruled.form == found.node, "left").select(ruled["*"], F.coalesce("label", "form").alias("alias_of"))
    judged = pages_labelled.join(by_label, pages_labelled.alias_of == by_label.label, "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", "inherited", F.lit("allow")).alias("verdict"), "alias_of")
