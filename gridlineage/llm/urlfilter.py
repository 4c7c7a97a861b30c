"""URL filters: rules by host and path, carried on to aliases by redirects and canonical links."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from string import ascii_lowercase, ascii_uppercase
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import small, stored
from .minhash import components

#: Pages without one of these words hold neither a canonical link nor a redirect.
WORDS = "(?i)canonical|refresh"
_REFRESH = re.compile(r"""\s*[\d.]+\s*[;,]\s*(?:url\s*=)?\s*["']?([^"']*)""", re.IGNORECASE)


def host_of(url: Column) -> Column:
    """What stands between the first '://' and the next '/', '?', '#' or the end, A-Z in lower case; null or without '://': empty."""
    return F.translate(_taken(url, 1), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end; null or without '://': empty."""
    return _taken(url, 2)


def _taken(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def resource(url: Column) -> Column:
    """What a url names: without fragment, scheme and host in lower case, an empty path as '/', an empty query as none; null if it has no host."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    path, query = path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]+)", 1)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query))


class Links(HTMLParser):
    """Where a page says that it really is: canonical links and redirects of its own, outside comments and scripts."""

    def __init__(self):
        super().__init__()
        self.base, self.found = None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "base" and self.base is None:
            self.base = a.get("href")
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a.get("href", ""))
        elif tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh" and (m := _REFRESH.match(a.get("content", ""))):
            self.found.append(m.group(1))


def targets(url: str, html: str) -> list[str]:
    """Absolute urls of a page's canonical links and redirects; a target that can't be read is none."""
    links = Links()
    links.feed(html)
    links.close()
    out = []
    for href in links.found:
        try:
            if href.strip():
                out.append(urljoin(urljoin(url, links.base or ""), href.strip()))
        except ValueError:
            pass
    return out


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) of every canonical link and redirect; pages without url or html have none.

    Pages that hold neither word never leave the JVM. Links between a resource and itself are left out.
    """

    def run(batches):
        for b in batches:
            src, dst = [], []
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = targets(u, h)
                src += [u] * len(found)
                dst += found
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src", "dst"])

    held = pages.select(F.col(url).alias("u"), F.col(html).alias("h")).filter(F.col("u").isNotNull() & F.col("h").rlike(WORDS))
    links = held.mapInArrow(run, "src string, dst string").select(resource(F.col("src")).alias("src"), resource(F.col("dst")).alias("dst"))
    return links.filter(F.col("src") != F.col("dst")).distinct()


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of those of `places` (host, path; each once) that a rule (host, path, verdict) fits.

    A rule fits its host and all subdomains if the path starts with its own. Of rules that fit, the longest
    (host and path together) wins, then the one of the longer host, then an allow. Hosts are cut at their
    dots and paths at the lengths that rules have, and both meet rules by equality, so a list of any length
    is one join; the lengths are collected, as many as rules have different ones (a path's length at most).
    """
    sizes = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None)
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    heads = F.filter(F.transform(F.lit(sizes).cast("array<int>"), lambda k: F.substring(F.col("path"), F.lit(1), k)), lambda p: p.isNotNull())
    cut = places.filter("host <> ''").select("host", "path", F.explode(ends).alias("end")).select("host", "path", "end", F.explode(F.array_distinct(heads)).alias("head"))
    own = rules.select(F.col("host").alias("end"), F.col("path").alias("head"), "verdict").filter("end is not null and head is not null").dropDuplicates()
    rank = F.struct(F.length("end") + F.length("head"), F.length("end"), F.col("verdict") == "allow")
    fits = cut.join(small(own), ["end", "head"])
    return fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("end", "head").alias("rule"), "verdict"), rank).alias("x")).select("host", "path", "x.rule", "x.verdict")


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row for each page: its key, host, path, rule, verdict, and `by` (rule, alias or default).

    A page that a rule fits has the rule's verdict. Other pages have that of their aliases: resources
    connected by canonical links and redirects (those in the pages, and those of a table `redirects` of
    columns src and dst, such as a crawler's log) form a component, links to resources without a page
    included, and each is judged by the rules. An explicit allow among them goes before a block; where no rule
    fits any of them, and for pages without aliases, the verdict is allow. A null url, or one without
    '://', has empty host and path, no aliases and no rule. Rows that repeat stay; an empty table gives an
    empty result, and without rules everything is allowed. Further columns are left out.

    Components are found in rounds on ids that are dealt to urls that have links, so other pages never take
    part; what rules fit is joined by host and path, once for each distinct pair.
    """
    own = stored(pages.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), resource(F.col(url)).alias("name")), "urls")
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select(resource(F.col("src")).alias("src"), resource(F.col("dst")).alias("dst")).filter(F.col("src") != F.col("dst"))).distinct()
    links = checkpointed(links)
    names = stored(links.select(F.col("src").alias("name")).unionByName(links.select(F.col("dst").alias("name"))).distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    names = names.withColumns({"host": host_of(F.col("name")), "path": path_of(F.col("name"))})
    rule = checkpointed(ruled(own.select("host", "path").unionByName(names.select("host", "path")).distinct(), rules))
    rule_ = small(rule)
    out = own.join(rule_, ["host", "path"], "left")
    if links.isEmpty():
        alias = F.lit(None).cast("string")
    else:
        ids = links.join(names.select(F.col("name").alias("src"), F.col("id").alias("a")), "src").join(names.select(F.col("name").alias("dst"), F.col("id").alias("b")), "dst")
        members = names.join(components(ids.select("a", "b")), "id").join(rule_, ["host", "path"], "left").select("name", "comp", "verdict")
        fate = members.filter("verdict is not null").groupBy("comp").agg(F.min("verdict").alias("alias"))
        aliases = checkpointed(members.join(fate, "comp").select("name", "alias"))
        out = out.join(small(aliases), "name", "left")
        alias = F.col("alias")
    by = F.when(F.col("rule").isNotNull(), "rule").when(alias.isNotNull(), "alias").otherwise("default")
    return out.select(key, "host", "path", "rule", F.coalesce("verdict", alias, F.lit("allow")).alias("verdict"), by.alias("by"))
