"""URL filter: host and path rules, carried to aliases over redirects and canonical links.

Edges come from ``<link rel=canonical href=...>`` and ``<meta http-equiv=refresh>``
of the pages' own HTML.  Components of these edges share decisions: a url that no
rule names is blocked if its component holds a blocked url and no allowed one
(allow takes precedence), and is allowed otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaro.llm._work import let, settle, small_table
from tessaro.llm.components import connected_components

#: (action, host, path), fixed by the task.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: So many rules are literals of the plan; more are joined as a table.
MAX_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Up to the first of / ? #, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ? or #; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null; equal lengths: the longer host, then allow."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def matched_by_table(judged: DataFrame, rules: DataFrame) -> DataFrame:
    """judged with ``found``, as matching_rule has it, by equi joins with rules(action, host, path) of any number.

    A host is looked up by each of its suffixes, a path by its beginnings of the lengths
    that rules' paths have.
    """
    rules = settle(rules.select("action", F.col("host").alias("h"), F.col("path").alias("p")).distinct())
    lengths = F.array(*[F.lit(r[0]) for r in rules.select(F.length("p")).distinct().collect()])
    asked = judged.select("host", "path").distinct()
    labels = F.sequence(F.lit(1), F.size(F.split("host", "[.]")))
    asked = asked.select("host", "path", F.explode(F.transform(labels, lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))).alias("h"))
    begun = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    asked = asked.select("host", "path", "h", F.explode(begun).alias("p"))
    order = F.struct(F.length("h") + F.length("p"), F.length("h"), F.col("action") == "allow")
    rule = F.struct(F.concat("h", "p").alias("rule"), "action")
    best = asked.join(rules, ["h", "p"]).groupBy("host", "path").agg(F.max_by(rule, order).alias("found"))
    return judged.join(best, ["host", "path"], "left")


def node_of(url: Column) -> Column:
    """Key of the address that a url fetches: scheme and fragment left out, host lower-cased."""
    parts = lambda rest: F.xxhash64(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))
    return let(F.coalesce(_after_scheme(url), F.lit("")), parts)


def _attribute(tag: Column, name: str) -> Column:
    """Its value: to the closing quote, or without quotes to the next white space."""
    form = rf"""(?is)\b{name}\s*=\s*(?:"\s*([^">]*)|'\s*([^'>]*)|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, form, i) for i in (1, 2, 3)])


def _absolute(base: Column, link: Column) -> Column:
    """link as seen from base: absolute, //host, /path or beside base's last path part."""

    def resolved(x: Column) -> Column:
        beside = F.concat(F.regexp_extract(base, r"^[^?#]*?://[^/?#]*", 0), F.regexp_extract(F.concat(F.lit("/"), path_of(base)), r"^/?(.*/)", 1), x)
        return (
            F.when(x.contains("://"), x)
            .when(x.startswith("//"), F.concat(F.lit("http:"), x))
            .when(x.startswith("/"), F.concat(F.regexp_extract(base, r"^[^?#]*?://[^/?#]*", 0), x))
            .when(x != "", F.regexp_replace(beside, r"(://[^/?#]*)/*", "$1/"))
        )

    return let(F.trim(F.replace(link, F.lit("&amp;"), F.lit("&"))), resolved)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) node keys: each page and where it redirects or says its canonical place is."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>"), 0)
    tag = F.col("tag")
    target = F.when(tag.rlike(r"(?i)^<link\b") & (F.lower(F.trim(_attribute(tag, "rel"))) == "canonical"), _attribute(tag, "href")).when(
        tag.rlike(r"(?i)^<meta\b") & (F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh"),
        F.regexp_extract(tag, r"""(?is)\burl\s*=\s*["']?\s*([^"'>]*)""", 1),
    )
    links = settle(pages.where("html is not null and instr(url, '://') > 0").select("url", F.explode(tags).alias("tag")).select("url", target.alias("link")))
    ends = settle(links.where("link <> ''").select("url", _absolute(F.col("url"), F.col("link")).alias("to")).where("instr(to, '://') > 0"))
    return ends.select(node_of(F.col("url")).alias("src"), node_of(F.col("to")).alias("dst")).where("src <> dst")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Every row's verdict: (page_id, host, path, rule, verdict, component).

    ``pages`` needs page_id, url and html; other columns are not read.  ``rules`` are
    (action, host, path) tuples or a DataFrame of these columns.  A null url,
    or one without ``://``, has empty host and path, no rule, no aliases, and is
    allowed.  Null html has no edges.  Repeated rows are judged alike.  component
    is the node key of the url's group, null without a scheme.  No rows in, none out.
    """
    url = F.col("url")
    read = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.when(F.instr(url, "://") > 0, node_of(url)).alias("node"))
    if isinstance(rules, DataFrame) or len(rules) > MAX_RULES:
        listed = rules if isinstance(rules, DataFrame) else small_table(pages.sparkSession, [dict(zip(("action", "host", "path"), r)) for r in rules], "action: string, host: string, path: string")
        found = matched_by_table(read, listed)
    else:
        found = read.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    judged = settle(found.select("page_id", "host", "path", "node", "found.rule", "found.action"))
    roots = connected_components(alias_edges(pages.select("url", "html")))
    placed = judged.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    # Only groups that a rule names can change a verdict.
    named = (
        placed.where("action is not null and component is not null")
        .groupBy("component")
        .agg(F.bool_or(F.col("action") == "block").alias("blocks"), F.bool_or(F.col("action") == "allow").alias("allows"))
        .where("blocks and not allows")
        .select("component", F.lit("block").alias("spread"))
    )
    verdict = F.coalesce("action", "spread", F.lit("allow"))
    return placed.join(named, "component", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
