"""URL filters by redirect equivalence, in DataFrame operations only.

Rules decide by host and path. Redirects and canonical links say which URLs are
one resource: connected components over these links carry a block to every
alias that has no rule of its own; an explicit allow stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcube.llm.common import fresh, need, stage
from gridcube.llm.components import connected_components
from gridcube.plans.strategy import join_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a rule table that is broadcast (some 100 bytes each); beyond, it is shuffled.
SMALL_RULES = 500_000

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: What may hold a tag that is none.
_HIDDEN = r"(?is)<!--.*?-->|<(script|style|template|noscript|textarea|title)\b.*?</\1\s*>"
_TAG = r"(?is)<(?:link|meta)\s[^>]*>"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
    A-Z in lower case; empty without ``://`` or for null."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """The name of a URL among aliases: host, path and query, without scheme
    and fragment; null for null and where there is no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), rest))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in either quotes or none; empty if it is missing."""
    value = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    text = F.concat(*[F.regexp_extract(tag, value, k) for k in (1, 2, 3)])
    return F.trim(F.regexp_replace(text, "&amp;|&#38;|&#[xX]26;", "&"))


def _target(tag: Column) -> Column:
    """Where a canonical link or an immediate redirect points; null for other tags."""
    rel = F.split(F.lower(_attribute(tag, "rel")), r"\s+")
    refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
    goes = F.regexp_extract(_attribute(tag, "content"), r"""(?is)^\s*[0-9.]+\s*[;,]\s*(?:url\s*=)?\s*["']?([^"']*)""", 1)
    link = F.lower(F.substring(tag, 1, 5)) == "<link"
    return F.when(link & F.array_contains(rel, "canonical"), _attribute(tag, "href")) \
        .when(~link & refresh, F.trim(goes))


def _steps(full: Column) -> Column:
    """``full`` without the segments ``.`` and ``..`` in its path."""
    parts = F.split(F.regexp_extract(full, r"(?s)^[^?#]*", 0), "/")
    walked = F.aggregate(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), F.array().cast("array<string>"),
                         lambda done, s: F.when(s == ".", done)
                         .when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
                         .otherwise(F.concat(done, F.array(s))))
    last = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    whole = F.concat(F.array_join(F.slice(parts, 1, 3), "/"), F.lit("/"), F.array_join(walked, "/"), last,
                     F.regexp_extract(full, r"(?s)[?#].*$", 0))
    return F.when(full.rlike(r"(?s)^[^?#]*/\.\.?(?:[/?#]|$)"), whole).otherwise(full)


def resolve(url: Column, target: Column) -> Column:
    """``target`` as written in the page at ``url``, as a full URL; null for
    other kinds of link (mail, script), and for a link within the page."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(path(url), r"(?s)^.*/", 0)
    folder = F.when(folder == "", "/").otherwise(folder)
    full = (F.when((target == "") | target.startswith("#"), None)
            .when(target.rlike(_SCHEME + "//"), target)
            .when(target.rlike(_SCHEME), None)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(origin, target))
            .when(target.startswith("?"), F.concat(origin, path(url), target))
            .otherwise(F.concat(origin, folder, target)))
    return _steps(full)


def page_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) of every canonical link and meta refresh in the whole pages,
    as full URLs. Tags in comments, scripts, styles, templates and the like
    are none. A page that names neither is read once and no more."""
    need(pages, url, html)
    page = F.col(f"`{html}`")
    shown = F.when(page.rlike("(?i)canonical|http-equiv"), F.regexp_replace(page, _HIDDEN, " "))
    tags = pages.select(F.col(f"`{url}`").alias("src"), F.explode(F.regexp_extract_all(shown, F.lit(_TAG), F.lit(0))).alias("tag"))
    full = resolve(F.col("src"), F.col("target"))
    return tags.select("src", _target(F.col("tag")).alias("target")).select("src", full.alias("dst")).where("dst IS NOT NULL")


def _longest_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(h, p, rule, verdict) for the distinct ``keys(h, p)`` that a rule fits.

    A key meets a rule by equality of a host suffix and of a path prefix as
    long as one of that host's rules, so a host with many rules is no product
    of URLs and rules; suffixes have at most as many labels as rules have."""
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"),
                         F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("verdict IN ('allow', 'block')").distinct()
    labels = F.size(F.split("rule_host", r"\."))
    most = rules.agg(F.max(labels)).first()[0] or 0
    if not most:
        return keys.limit(0).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    sizes = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("sizes"))
    parts = F.split("h", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))),
                       lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    on_host = join_small(keys.select("h", "p", F.explode(ends).alias("rule_host")), sizes, "rule_host", max_rows=SMALL_RULES)
    tried = on_host.select("h", "p", "rule_host", F.explode("sizes").alias("size")).where(F.col("size") <= F.length("p"))
    tried = tried.withColumn("rule_path", F.substring("p", F.lit(1), F.col("size")))
    fits = join_small(tried, rules, ["rule_host", "rule_path"], max_rows=SMALL_RULES)
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("size"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"), "verdict"))
    return fits.groupBy("h", "p").agg(best.alias("best")).select("h", "p", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", html: str = "html",
               redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with a struct column ``url_filter``: host, path, rule, verdict.

    ``rules(host, path, verdict)`` allow or block a host with all subdomains
    where the path starts with the rule's; the longest rule (host and path)
    decides. Among rules of one length an allow wins, then the last in
    code-point order. URLs without a rule are allowed unless they are aliases
    of a blocked one: linked with it, over any number of steps, by canonical
    links and meta refreshes in ``html`` or by ``redirects(src, dst)``, full
    URLs. The linked URLs need not be pages themselves. An allowed URL stays
    allowed whatever its aliases, and does not clear them.

    Defined cases: a null URL or one without ``://`` has an empty host and
    path, no aliases and (but for rules on the empty host) is allowed; a null
    html has no links; a rule with a null host or path has an empty one, with
    any other verdict it is ignored; repeated rows get equal results; an empty
    table gives an empty result. Other columns pass through; an existing
    column ``url_filter`` is replaced.
    """
    need(pages, url, html)
    need(rules, "host", "path", "verdict")
    pages = pages.drop("url_filter")
    links = page_links(pages, url=url, html=html)
    if redirects is not None:
        need(redirects, "src", "dst")
        links = links.unionByName(redirects.select("src", "dst"))
    links = stage(links.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b"))
                  .where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct(), "url-links")
    found = connected_components(links)
    member = found.select("node", "component", F.regexp_extract("node", r"(?s)^[^/?#]*", 0).alias("h"),
                          F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1).alias("p"))
    address = pages.select(host(F.col(f"`{url}`")).alias("h"), path(F.col(f"`{url}`")).alias("p"))
    ruled = stage(_longest_rules(address.unionByName(member.select("h", "p")).distinct(), rules), "url-rules")
    judged = member.join(ruled, ["h", "p"], "left")
    blocked = judged.where("verdict = 'block'").select("component").distinct()
    aliases = join_small(judged.where("verdict IS NULL"), blocked, "component", max_rows=SMALL_RULES).select("node").distinct()

    h, p, name, on_h, on_p, rule, verdict, alias = fresh(pages, "h", "p", "name", "on_h", "on_p", "rule", "verdict", "alias")
    here = F.col(f"`{url}`")
    rows = pages.withColumns({h: host(here), p: path(here), name: node(here)})
    rows = rows.join(ruled.toDF(on_h, on_p, rule, verdict), (F.col(h) == F.col(on_h)) & (F.col(p) == F.col(on_p)), "left")
    rows = join_small(rows, aliases.toDF(alias), F.col(name) == F.col(alias), "left", max_rows=SMALL_RULES)
    final = F.coalesce(verdict, F.when(F.col(alias).isNotNull(), "block").otherwise("allow"))
    return rows.withColumn("url_filter", F.struct(
        F.col(h).alias("host"), F.col(p).alias("path"), F.col(rule).alias("rule"), final.alias("verdict"))) \
        .select(*[F.col(f"`{c}`") for c in pages.columns], "url_filter")
