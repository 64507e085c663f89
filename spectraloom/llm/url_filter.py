"""Operator 8: URL filters whose block decisions reach aliases, with DataFrame functions only.

Pages that redirect to one another, or name one canonical URL, are one resource. Edges come from
``<link rel=canonical>``, ``<meta http-equiv=refresh>`` and, where given, a redirect table; their
connected components carry a block from any member that a rule blocks to every member without a rule
of its own. An explicit allow comes first: it decides its own URL, and in a component that holds one
no block is passed on.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, meets no rule and is
allowed unless an alias is blocked; null html has no edge; targets may be relative; repeated rows stay repeated; empty tables
give empty results; other columns are ignored. Rules are a driver-side list of at most ``MAX_RULES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import components, materialize

MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, with A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, null if none does; of equal ones an allow."""
    rules = RULES if rules is None else rules
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def key_of(url: Column) -> Column:
    """A URL without scheme and fragment, host lower-cased: the node of the alias graph."""
    return F.concat(host_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def _without_dots(path: Column) -> Column:
    """``path``, which begins with a slash, without the segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step), "/"))


def resolved(url: Column, target: Column) -> Column:
    """``target`` of a link in the page ``url``, absolute and without its fragment; null if it is the page itself."""
    t = target
    for name, char in (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.trim(t), r"(?s)#.*$", "")
    path, query = F.regexp_extract(t, r"(?s)^([^?]*)", 1), F.regexp_extract(t, r"(?s)(\?.*)$", 1)
    site, base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    folder = F.coalesce(F.nullif(F.regexp_extract(base, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    whole = F.when(t == "", None).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t).when(t.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?):", 1), F.lit(":"), t))
    return whole.when(path == "", F.concat(site, base, query)).when(t.startswith("/"), F.concat(site, _without_dots(path), query)).otherwise(F.concat(site, _without_dots(F.concat(folder, path)), query))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``src, dst`` nodes from canonical links and refreshes in ``pages(url, html)`` and from ``redirects(url, target)``."""
    # most pages have neither tag: a substring test comes before any regular expression
    tagged = pages.select("url", "html").where("html is not null and url is not null").where(F.lower("html").contains("canonical") | F.lower("html").contains("http-equiv"))
    tags = tagged.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))).alias("tag"))
    link = F.when(F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    target = F.when(F.col("tag").rlike(r"(?is)^<meta\b.*http-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)).otherwise(link)
    found = tags.select("url", target.alias("target"))
    if redirects is not None:
        found = found.unionByName(redirects.select("url", "target"))
    found = found.where("target is not null and target <> ''")
    full = resolved(F.col("url"), F.col("target"))
    return found.select(key_of(F.col("url")).alias("src"), key_of(full).alias("dst")).where("src <> '' and dst <> ''")


def blocked_aliases(edges: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The nodes, ``key``, of components that hold a blocked URL and no explicitly allowed one."""
    comps = components(edges).withColumnRenamed("node", "key")
    url = F.concat(F.lit("x://"), F.col("key"))
    verdict = rule_for(host_of(url), path_of(url), rules)["verdict"]
    state = comps.withColumn("verdict", verdict).groupBy("component").agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("b"), F.max(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("a"))
    return comps.join(state.where("b = 1 and a = 0").select("component"), "component").select("key").distinct()


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page."""
    edges = materialize(alias_edges(pages, redirects).distinct())
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        rows = rows.withColumn("alias", F.lit(None).cast("string"))
    else:
        bad = blocked_aliases(edges, rules).select(F.col("key").alias("alias"))
        rows = rows.join(bad, key_of(F.col("url")) == F.col("alias"), "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("alias").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
