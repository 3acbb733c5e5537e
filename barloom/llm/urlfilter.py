"""URL filters: rules first, then block decisions propagated over redirect and canonical-link aliases.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, spread_join
from .components import connected_components

URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: (host, path, verdict) of the production list
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host after the first ``://``; empty for null or no ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL_PATTERN, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """Identity of a URL in the alias graph: host, path and query; scheme and fragment don't count."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, says) of the longest rule that fits, else null; between rules of one length allow wins.

    ``rules`` is configuration: it becomes one array literal, sorted here, of which the first fitting entry counts.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0], r[1]))
    known = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(says).alias("says")) for h, p, says in ordered])
    fits = F.filter(
        known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    )
    first = F.try_element_at(fits, F.lit(1))
    return F.when(first.isNotNull(), F.struct(F.concat(first["host"], first["path"]).alias("rule"), first["says"].alias("says")))


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v) alias edges: each page's canonical link and meta-refresh target, resolved against its url.

    A page without url, html or such a tag gives no edge.
    """
    def value(tag: Column, name: str) -> Column:
        return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(["']?)(.*?)\1(?=[\s>"'])""", 2)

    tags = (
        pages.where(F.col("url").contains("://") & F.col("html").isNotNull())
        .where(F.col("html").rlike(r"""(?is)<link\b[^>]*canonical|<meta\b[^>]*refresh"""))
        .select("url", F.explode(F.expr(r"regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>', 0)")).alias("tag"))
    )
    attrs = tags.select(
        "url",
        F.lower(F.substring("tag", 2, 4)).alias("kind"),
        *[value(F.col("tag"), name).alias(at) for name, at in (("rel", "rel"), ("href", "href"), ("http-equiv", "equiv"), ("content", "content"))],
    )
    target = F.when((F.col("kind") == "link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical"), F.col("href")).when(
        (F.col("kind") == "meta") & (F.lower(F.trim("equiv")) == "refresh"), F.regexp_extract("content", r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1)
    )
    found = attrs.select("url", F.replace(F.trim(target), F.lit("&amp;"), F.lit("&")).alias("to"))
    root = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    resolved = (
        F.when(F.col("to").rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(root, F.col("to")))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), F.col("to")))
    )
    ends = found.where("to <> ''").select("url", resolved.alias("target"))
    pair = F.struct(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v"))
    # explode keeps later filters on u and v from being copied into the parsing above
    return ends.select(F.explode(F.array(pair)).alias("e")).select("e.u", "e.v")


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Verdict per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, by_alias.

    A url that a rule fits has the rule's verdict, allow or block, whatever its aliases say.  Any other
    is blocked if a url of its alias component (redirects, canonical links, meta refreshes) is
    blocked by a rule, and allowed otherwise.  ``redirects`` (source, target) adds edges from a crawl log;
    ``edges`` (u, v) replaces those read from the html.  Null or malformed urls have empty host and path
    and are allowed; repeated rows are judged one by one; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urlfilter")
    links = link_edges(pages) if edges is None else edges
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v")))
    members = connected_components(links, scratch)
    parsed = members.select("*", F.concat(F.lit("x://"), F.col("node")).alias("url"))
    parsed = parsed.select("node", "component", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = parsed.where(best_rule(F.col("host"), F.col("path"), rules)["says"] == "block").select("component").distinct()
    aliases = members.join(bad, "component", "left_semi").select("node", F.lit(True).alias("by_alias"))

    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.select("*", best_rule(F.col("host"), F.col("path"), rules).alias("best"))
    judged = judged.select("page_id", "host", "path", "node", F.col("best.rule").alias("rule"), F.col("best.says").alias("said"))
    # null urls, malformed ones and a url that very many rows have are dealt to many tasks
    return spread_join(judged, aliases, "node", F.xxhash64("page_id", "host", "path"), "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("said", F.when(F.col("by_alias"), "block").otherwise("allow")).alias("verdict"),
        (F.col("said").isNull() & F.coalesce("by_alias", F.lit(False))).alias("by_alias"),
    )
