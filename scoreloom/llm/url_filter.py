"""URL filters: block and allow rules, carried over to the aliases of a URL."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import let, query, stored, table
from scoreloom.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # block or allow
    host: str
    path: str


#: The rules of the query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What names a page: host, path and query. Scheme and fragment don't; null if there is no host."""
    def joined(rest: Column) -> Column:
        host, tail = F.regexp_extract(rest, r"^[^/?#]*", 0), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
        return F.when(host != "", F.concat(lowered(host), tail))

    return let(_rest(url), joined)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule for a host, its parent domains and a path: struct(rule, verdict), or null."""
    longest_first = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path, r.verdict))
    fits = [
        F.when(
            ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path),
            F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in longest_first
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _resolved(target: Column, url: Column) -> Column:
    """A link target as a full URL, relative ones read from the page's own URL."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"^(.*/)?", 0)
    below = let(folder, lambda f: F.when(f == "", F.lit("/")).otherwise(f))
    return let(target, lambda t: (
        F.when(t.contains("://"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(site, t))
        .when(t != "", F.concat(site, below, t))
    ))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses: from a page to its canonical link and to where a refresh sends it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    attribute = lambda tag, name: F.trim(F.concat(
        F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*"([^"]*)\"""", 1),
        F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*'([^']*)'""", 1),
        F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*([^\s"'>]+)""", 1),
    ))
    canonical = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: lowered(attribute(t, "rel")) == "canonical"),
        lambda t: attribute(t, "href"),
    )
    refresh = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: lowered(attribute(t, "http-equiv")) == "refresh"),
        lambda t: F.trim(F.regexp_extract(attribute(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1)),
    )
    links = pages.select("url", F.explode(F.concat(canonical, refresh)).alias("_to"))
    return links.select(address(F.col("url")).alias("src"), address(_resolved(F.col("_to"), F.col("url"))).alias("dst")).where(
        F.col("src").isNotNull() & F.col("dst").isNotNull()
    )


def url_verdicts(
    pages: DataFrame, rules: Sequence[Rule], carry: Sequence[str], redirects: DataFrame | None = None
) -> DataFrame:
    """The columns `carry` of `pages` (url, html) with _host, _path, _rule, _verdict and _class.

    A page's own rule decides first. Addresses joined by canonical links, refreshes and the rows of
    `redirects` (src_url, dst_url) are aliases: all of one class, however long the chain. A page
    without a rule is allowed if any address of its class, a page or not, has an allow rule, else
    blocked if any has a block rule, else allowed. A null url, or one without a host, has no aliases and is allowed.
    Repeated pages are judged alike. No pages give no rows. Addresses and pages may be of any length;
    carried columns may have any names.
    """
    names = {c: f"_kept_{i}" for i, c in enumerate(carry)}
    edges = alias_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(
            redirects.select(address(F.col("src_url")), address(F.col("dst_url"))).dropna()
        )
    classes = components(edges)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = classes.withColumn("_v", fitting_rule(host_of(as_url), path_of(as_url), rules)["verdict"])
    decided = ruled.groupBy("component").agg(
        F.coalesce(F.max(F.col("_v") == "allow"), F.lit(False)).alias("_allow"),
        F.coalesce(F.max(F.col("_v") == "block"), F.lit(False)).alias("_block"),
    )
    verdicts = stored(
        classes.join(decided, "component").select(
            F.col("node").alias("_address"),
            F.col("component").alias("_class"),
            F.when(F.col("_allow") | ~F.col("_block"), "allow").otherwise("block").alias("_alias"),
        ),
        "aliases",
    )
    own = pages.select(
        *[F.col(f"`{c}`").alias(m) for c, m in names.items()],
        host_of(F.col("url")).alias("_host"),
        path_of(F.col("url")).alias("_path"),
        address(F.col("url")).alias("_address"),
    ).withColumn("_own", fitting_rule(F.col("_host"), F.col("_path"), rules))
    return own.join(verdicts, "_address", "left").select(
        *[F.col(m).alias(c) for c, m in names.items()],
        "_host",
        "_path",
        F.col("_own.rule").alias("_rule"),
        F.coalesce(F.col("_own.verdict"), F.col("_alias"), F.lit("allow")).alias("_verdict"),
        "_class",
    )


# The given pages hold neither canonical links nor refreshes (a test counts them), so a verdict
# without a rule is "allow" there; tests compare the aliases with a brute-force search.
@query(
    "op2_url_filter",
    r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT s.page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(h || p) DESC) AS k
  FROM split s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT s.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (page_id)
""",
)
def op2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_verdicts(pages, RULES, ["page_id"]).select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"),
    )
