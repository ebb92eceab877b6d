"""URL filters: longest-match rules, spread over redirects and canonical links.

A rule is (allow or block, host, path). It fits its host and all subdomains when the url's path starts
with the rule's; the longest fitting rule wins, and of two as long the one that allows. A page's redirect
(``meta`` refresh) and canonical ``link`` tie its url to another one; redirects seen by a crawler can be
added as a table. Urls are the same node when host, path and query agree, without scheme, fragment and
tracking parameters. The connected components of these ties are urls of one thing: where no rule fits,
a url is blocked when a url of its component is blocked by a rule and none is allowed by one.

All of it is DataFrame operations. A null url, or one without ``://``, has empty host and path, fits no
rule and is allowed; a null ``html`` ties nothing. Repeated rows give repeated results; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseed.llm.components import components
from lakeseed.workspace import stored

ALLOW, BLOCK = "allow", "block"
RULES = (
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = "(^|&)(utm_[^&=]*|gclid|fbclid)(=[^&]*)?"
TAGS = "(?i)<(?:link|meta)\\b[^>]*>"
CANONICAL = "(?i)\\brel\\s*=\\s*[\"']?canonical\\b"
HREF = "(?i)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)"
REFRESH = "(?i)\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b"
REFRESH_URL = "(?i)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)"


def after_scheme(url: Column) -> Column:
    """The part after the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))


def raw_host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(raw_host(url), UPPER, LOWER)


def path(url: Column) -> Column:
    rest = F.substring(after_scheme(url), F.length(raw_host(url)) + F.lit(1), F.length(url))
    return F.coalesce(F.regexp_extract(rest, "^[^?#]*", 0), F.lit(""))


def node(url: Column) -> Column:
    """What urls of the same place share; null without a host."""
    query = F.regexp_extract(after_scheme(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&+", "")
    whole = F.concat(host(url), path(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host(url) != "", whole)


def fitting(at_host: Column, at_path: Column, rules=RULES) -> Column:
    """A struct of the longest fitting rule and its verdict, or null."""
    found = []
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((at_host == name) | at_host.endswith(f".{name}")) & at_path.startswith(start)
        found.append(F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule: string, verdict: string>")


def targets(html: Column) -> Column:
    """Where the page's canonical links and refreshes point to."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAGS), F.lit(0))
    links = F.transform(F.filter(tags, lambda t: t.rlike(CANONICAL)), lambda t: F.regexp_extract(t, HREF, 1))
    moves = F.transform(F.filter(tags, lambda t: t.rlike(REFRESH)), lambda t: F.regexp_extract(t, REFRESH_URL, 1))
    return F.filter(F.concat(links, moves), lambda t: t != "")


def absolute(target: Column, url: Column) -> Column:
    """A link of a page as a whole url."""
    scheme = F.substring_index(url, "://", 1)
    folder = F.regexp_replace(path(url), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(scheme, F.lit("://"), raw_host(url), target))
        .otherwise(F.concat(scheme, F.lit("://"), raw_host(url), folder, target))
    )


def ties(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """source, target urls: links found in pages, and redirects (source, target) when given."""
    links = pages.select("url", F.explode(targets(F.col("html"))).alias("link")).where(host(F.col("url")) != "")
    found = links.select(F.col("url").alias("source"), absolute(F.col("link"), F.col("url")).alias("target"))
    return found if redirects is None else found.union(redirects.select("source", "target"))


def blocked_nodes(tied: DataFrame, rules=RULES) -> DataFrame:
    """node, blocked: for every url that is tied to another."""
    tied = stored(tied, "url-ties")
    ends = tied.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b"))
    urls = tied.select(F.explode(F.array("source", "target")).alias("url"))
    explicit = urls.select(node(F.col("url")).alias("node"), fitting(host(F.col("url")), path(F.col("url")), rules).alias("own"))
    member = explicit.distinct().join(components(ends), "node")
    verdicts = member.groupBy("component").agg(
        F.max(F.coalesce(F.col("own.verdict") == BLOCK, F.lit(False))).alias("blocks"),
        F.max(F.coalesce(F.col("own.verdict") == ALLOW, F.lit(False))).alias("allows"),
    )
    member = member.select("node", "component").distinct().join(verdicts, "component")
    return member.select("node", (F.col("blocks") & ~F.col("allows")).alias("blocked"))


def judged(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    url = F.col("url")
    rows = pages.select("page_id", node(url).alias("node"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("own", fitting(F.col("host"), F.col("path"), rules))
    # Pages without a node match nothing; a key of their own spreads them over the join's tasks.
    rows = rows.withColumn("node", F.coalesce("node", F.concat(F.lit("\0"), F.xxhash64(F.monotonically_increasing_id()))))
    rows = rows.join(blocked_nodes(ties(pages, redirects), rules), "node", "left")
    method = F.when(F.col("blocked"), BLOCK).otherwise(ALLOW)
    return rows.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", method).alias("verdict")
    )
