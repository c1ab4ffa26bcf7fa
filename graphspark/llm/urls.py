"""URL filter: host and path rules, and redirect equivalence that carries blocks to aliases."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import cut
from graphspark.llm.components import connected_components

#: Rules become one CASE expression, so their number has a bound.
MAX_RULES = 1000

_CANONICAL = r"(?i)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?i)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"
_TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    if not slash or not host:
        raise ValueError(f"a rule is host/path: {rule!r}")
    return host, "/" + path


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null where none does.

    ``rules`` are (``allow`` or ``block``, ``host/path``). A rule fits its host and all subdomains
    of it, if the path starts with the rule's. Of equal rules ``allow`` wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        h, p = _split(text)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_key(url: Column) -> Column:
    """The url without its fragment: what a redirect or a canonical link can name."""
    return F.regexp_replace(url, r"(?s)#.*\z", "")


def _resolve(target: Column, url: Column) -> Column:
    """An absolute url for a link target; relative ones stand against the page's url."""
    scheme = F.regexp_extract(url, r"(?s)\A(.*?)://", 1)
    site = F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*)", 1)
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(url_path(url), r"(?s)\A(.*/)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(folder, target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): url keys that a page's canonical link or refresh redirect declares the same.

    The first canonical link and the first refresh redirect of a page count.
    """
    html, url = F.col("html"), F.col("url")
    linked = pages.select("url", "html").where(
        url.contains("://") & html.rlike(r"(?i)canonical|refresh")
    )
    targets = F.array(
        F.regexp_extract(F.regexp_extract(html, _CANONICAL, 1), _HREF, 1),
        F.regexp_extract(F.regexp_extract(html, _REFRESH, 1), _TARGET, 1),
    )
    found = linked.select("url", F.explode(targets).alias("target")).where("target <> ''")
    found = found.select(url_key(url).alias("src"), url_key(_resolve(F.col("target"), url)).alias("dst"))
    return found.where("src <> dst").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_verdict) for every row of ``pages``.

    A page's own rule decides first, so an explicit allow is never overturned. A page without one
    takes the decision of its aliases, the urls connected to its own over redirects and canonical
    links: ``allow`` if any of them is explicitly allowed, else ``block`` if any is blocked
    (``alias_verdict``; null without a ruled alias), else ``default``. A target counts by its url
    alone, whether or not it is itself a row. Null urls and urls without ``://`` have empty host
    and path, no rule and no aliases; null html declares nothing. Repeated rows stay.
    """
    edges = cut(alias_edges(pages))
    keys = edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct()
    nodes = cut(keys.withColumn("id", F.monotonically_increasing_id()))
    numbered = (
        edges.join(nodes.select(F.col("key").alias("src"), F.col("id").alias("a")), "src")
        .join(nodes.select(F.col("key").alias("dst"), F.col("id").alias("b")), "dst")
        .select("a", "b")
    )
    member = connected_components(numbered).join(nodes, F.col("node") == F.col("id")).select("key", "component")
    _, decision = match_rule(url_host(F.col("key")), url_path(F.col("key")), rules)
    member = member.withColumn("decision", decision)
    groups = member.groupBy("component").agg(
        F.min("decision").alias("alias_verdict")  # "allow" sorts before "block"
    )
    aliases = member.join(groups, "component").select("key", "alias_verdict")

    url = F.col("url")
    host, path = url_host(url), url_path(url)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select("page_id", url, host.alias("host"), path.alias("path"), url_key(url).alias("key"))
        .join(aliases, "key", "left")
        .select("page_id", "host", "path", rule.alias("rule"), verdict.alias("own"), "alias_verdict")
    )
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("own", "alias_verdict", F.lit(default)).alias("verdict"), "alias_verdict"
    )
