"""Operator 6, URL filters, with DataFrame functions only.

Rules name a host and a path; the longest that fits a url decides.  Pages that redirect to each other or name the
same canonical page are one page under several names: connected components over those links carry a block from any
member to all that no rule allows.

Links are read from the pages' own html, all of a page: ``<link rel=canonical href=...>`` and ``<meta http-equiv=refresh
content="0; url=...">``, values quoted or not, attributes in any order, ``&amp;`` decoded.  Relative ones are resolved against the page's
url, dot segments taken out.  Links and pages meet by name: the url without its fragment, scheme and host lower-cased,
an empty path as ``/``.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule fits it and it has no links; of two
equally long rules, allow wins; pages are judged by their url, so repeated rows get the same verdict, and a null
page_id passes; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haloforge.llm.components import components
from haloforge.llm.store import materialize

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Patterns that Java and RE2 read alike.
TAG = r"(?i)<(?:link|meta)[\s/][^>]*>"
ATTRIBUTE = r"""(?i)[\s"'/]{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CANONICAL = r"(?i)(?:^|\s)canonical(?:\s|$)"
REFRESH = r"(?is)^[^;,]*[;,]\s*url\s*=(.*)$"
AROUND = r"""^[\s"']+|[\s"']+$"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for a null or a url without ``://``."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def judge_by_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) that a rule fits -> rule, rule_verdict of the longest.  Rules are joined on the hosts'
    suffixes, of no more labels than the longest rule has, so a long list of rules is no broadcast."""
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    host_labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(host_labels), F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(host_labels, -k, k), "."))
    named = places.where("host <> ''").select("host", "path", F.explode(ends).alias("rule_host"))
    fits = named.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"), "verdict")).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def _lower(c: Column) -> Column:
    """A-Z alone."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _attribute(tag: Column, name: str) -> Column:
    pattern = ATTRIBUTE.format(name)
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def _without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments; a last one leaves a slash."""
    none = F.array().cast("array<string>")
    step = lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.concat(held, F.array(x)))
    joined = F.array_join(F.aggregate(F.split(path, "/", -1), none, step), "/")
    return F.when(path.rlike(r"/\.\.?$"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolved(to: Column, src: Column) -> Column:
    """A link's target as a whole url."""
    scheme = F.regexp_extract(src, f"(?s)({SCHEME})//", 1)
    root = F.regexp_extract(src, r"(?s)^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(src, r"(?s)^[^:/?#]+://[^/?#]*(/[^?#]*/|/)", 1)
    file = F.regexp_extract(src, r"(?s)^([^?#]*)", 1)
    path = F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    after = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(to.rlike(SCHEME), to)
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("?"), F.concat(file, to))
        .when(to.startswith("#"), src)
        .when(to.startswith("/"), F.concat(root, _without_dots(path), after))
        .otherwise(F.concat(root, _without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)), after))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) of all canonical links and refresh redirects in the pages' own html."""
    tags = pages.select(F.col(url).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(TAG), F.lit(0))).alias("tag")).where(F.instr("src", "://") > 0)
    tag, is_link = F.col("tag"), _lower(F.substring("tag", 1, 5)) == "<link"
    canonical = F.when(is_link & _attribute(tag, "rel").rlike(CANONICAL), _attribute(tag, "href"))
    refresh = F.when(~is_link & (_lower(F.btrim(_attribute(tag, "http-equiv"))) == "refresh"), F.regexp_extract(_attribute(tag, "content"), REFRESH, 1))
    to = F.replace(F.regexp_replace(F.coalesce(canonical, refresh), AROUND, ""), F.lit("&amp;"), F.lit("&"))
    found = tags.select("src", to.alias("to")).where("to <> ''")
    return found.select("src", resolved(F.col("to"), F.col("src")).alias("dst")).where(F.instr("dst", "://") > 0)


def name_of(url: Column) -> Column:
    """What links and pages meet by: the url without its fragment, scheme and host lower-cased, an empty path as ``/``."""
    root = F.regexp_extract(url, r"(?s)^([^:/?#]+://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]+://[^/?#]*([^#]*)", 1)
    return F.when(root != "", F.concat(_lower(root), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))).otherwise(F.regexp_extract(url, r"(?s)^([^#]*)", 1))


def judge_pages(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url[, html]) -> page_id, host, path, rule, verdict.  links (src, dst): redirects known from
    elsewhere; links in ``html`` count in any case."""
    found = page_links(pages) if "html" in pages.columns else None
    if links is not None:
        given = links.select(F.col("src"), F.col("dst"))
        found = given if found is None else found.union(given)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), name_of(F.col("url")).alias("name"))
    if found is None:
        groups = rows.select(F.col("name"), F.col("name").alias("group")).limit(0)
    else:
        groups = components(found.select(name_of(F.col("src")).alias("a"), name_of(F.col("dst")).alias("b"))).select(F.col("node").alias("name"), F.col("label").alias("group"))
    # A block counts from every name of the group, whether or not its page is in the table.
    host, path = host_and_path(F.col("name"))
    named = groups.select("name", "group", host.alias("host"), path.alias("path"))
    places = rows.select("host", "path").union(named.select("host", "path")).distinct()
    ruled = materialize(judge_by_rules(places, rules), "ruled")
    blocked = named.join(ruled, ["host", "path"]).where("rule_verdict = 'block'").select("group").distinct()
    blocked = materialize(blocked, "blocked")  # a written table, so that a group of very many aliases can be split
    aliases = named.join(blocked, "group", "left_semi").select("name").distinct().withColumn("alias_blocked", F.lit(True))
    aliases = materialize(aliases, "aliases")
    verdict = F.coalesce("rule_verdict", F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow"))
    # Neither table has a bound, so neither is broadcast.
    return rows.join(ruled.hint("merge"), ["host", "path"], "left").join(aliases.hint("merge"), "name", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
