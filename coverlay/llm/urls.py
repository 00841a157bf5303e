"""URL filter: longest-match rules, and block decisions that spread over redirect aliases.

Canonical links and refresh redirects in the pages, and redirects given as a table, say that
two addresses are one resource.  Components of that graph are aliases; a page that no rule
fits is blocked if an alias is.  A page's own rule always wins, an explicit allow included.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from coverlay.llm.columns import ascii_lower
from coverlay.llm.components import components
from coverlay.operators.lineage import settle
from coverlay.operators.lookup import lookup

#: Rules that take at most this many bytes are broadcast.
BROADCAST_BYTES = 32 << 20
#: What a broadcast row takes beside its texts, about.
RULE_BYTES = 100


class Rule(NamedTuple):
    """A verdict for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for urls without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(rest: Column) -> Column:
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(rules: DataFrame) -> DataFrame:
    """``rule_host, rule_path, verdict, rule``, one row for each host and path.

    Of two verdicts for one host and path the allow counts.  Rules with a null are left out.
    """
    whole = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").dropna()
    return whole.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict")).withColumn("rule", F.concat("rule_host", "rule_path"))


def _attach(rows: DataFrame, table: DataFrame, keys: list[str], found: str, spread: Sequence[Column | str]) -> DataFrame:
    """Left join that adds ``found``, the columns of ``table`` as a struct; hot keys are split."""
    weighed = table.join(rows.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    return lookup(rows, weighed, keys, "_n", rows.count(), found, spread)


def judge(addresses: DataFrame, rules: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``host, path, rule, verdict``: the longest rule that fits, for addresses with one.

    ``addresses`` holds distinct ``host, path``.  Rules of one length: allow before block,
    then by name.  Hosts are cut into their last labels, as many as a rule's host has, and
    paths to the lengths that the rules of a found host have, so that both joins are on equal
    keys and a page meets the rules that fit it, however many there are.  Rules that measure
    at most ``broadcast_bytes`` are broadcast; more are shuffled, hot hosts split.
    """
    table = settle(rule_table(rules))
    labels = F.size(F.split("rule_host", r"\."))
    measured = table.agg(F.max(labels).alias("labels"), F.sum(F.octet_length("rule") * 2 + RULE_BYTES).alias("bytes")).first()
    small = (measured["bytes"] or 0) <= broadcast_bytes

    def meet(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
        if small:
            return rows.join(F.broadcast(other), keys)
        values = [c for c in other.columns if c not in keys]
        return _attach(settle(rows), other, keys, "_met", ["host", "path"]).filter("_met IS NOT NULL").select(*rows.columns, *(f"_met.{v}" for v in values))

    hosts = table.groupBy("rule_host").agg(F.collect_set(F.char_length("rule_path")).alias("lengths"))
    cuts = F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(measured["labels"] or 1)))
    last = F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("cut"))
    named = addresses.select("host", "path", F.explode(cuts).alias("cut")).select("host", "path", last.alias("rule_host"))
    lengths = F.filter("lengths", lambda n: n <= F.char_length("path"))
    starts = meet(named, hosts, ["rule_host"]).select("host", "path", "rule_host", F.explode(lengths).alias("cut"))
    starts = starts.select("host", "path", "rule_host", F.substr("path", F.lit(1), F.col("cut")).alias("rule_path"))
    best = F.min(F.struct(-F.char_length("rule"), "verdict", "rule")).alias("best")
    return meet(starts, table, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def address(rest: Column) -> Column:
    """Host, path and query: one node for all schemes and fragments of an address."""
    tail = F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1)
    return F.concat(host_of(rest), F.when(F.startswith(tail, F.lit("/")), tail).otherwise(F.concat(F.lit("/"), tail)))


def _target(link: Column, rest: Column) -> Column:
    """The address that a link in a page at ``rest`` leads to."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    folder = F.concat(host_of(rest), F.regexp_extract(F.concat(path_of(rest), F.lit("")), "^(.*/)?", 0))
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), address(after_scheme(link)))
        .when(F.startswith(link, F.lit("//")), address(F.substr(link, F.lit(3))))
        .when(F.startswith(link, F.lit("/")), address(F.concat(host_of(rest), link)))
        .when((link == "") | F.startswith(link, F.lit("#")), F.lit(None))
        .otherwise(address(F.concat(folder, link)))
    )


def _links(html: Column) -> Column:
    """Links of canonical and refresh tags; scripts' redirects are not read."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?\s*canonical\b"))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"))
    hrefs = F.transform(canonical, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]*)", 1))
    moves = F.transform(refresh, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]*)", 1))
    both = F.filter(F.concat(hrefs, moves), lambda x: x != "")
    return F.when(html.rlike("(?i)canonical|refresh"), both)


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a, b``: address of a page and one it names as canonical or redirects to.  Pages
    without a host, and without such tags, give none."""
    rest = after_scheme(F.col(url))
    found = pages.select(rest.alias("rest"), F.explode(_links(F.col(html))).alias("link")).filter(host_of(F.col("rest")) != "")
    return found.select(address(F.col("rest")).alias("a"), _target(F.col("link"), F.col("rest")).alias("b"))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame | Sequence[Rule],
    url: str = "url",
    html: str = "html",
    redirects: DataFrame | None = None,
    otherwise: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Every page with ``host, path, rule, verdict, alias`` added.

    ``rules`` is a table with ``verdict, host, path`` or a short list; no rules judge nothing.
    ``redirects`` may hold ``from_url, to_url``.  ``verdict`` is the longest rule's; without
    one it is ``block`` if an alias is blocked by a rule, else ``otherwise``.  ``alias`` is
    the smallest address of the page's component, null if the page has no alias.  A null or
    schemeless url has an empty host and path and no alias; null and empty pages give no
    edges; equal rows are judged alike; an empty table gives no rows.  The added columns must
    not exist, in any case of letters; other columns may have any name.
    """
    clash = {"host", "path", "rule", "verdict", "alias"} & {c.lower() for c in pages.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    edges = page_edges(pages, url, html)
    if redirects is not None:
        a, b = (after_scheme(F.col(c)) for c in ("from_url", "to_url"))
        given = redirects.filter((host_of(a) != "") & (host_of(b) != ""))
        edges = edges.unionByName(given.select(address(a).alias("a"), address(b).alias("b")))
    # Names of our own, so that no column of the pages is in the way.
    held = {c: f"in{i}" for i, c in enumerate(pages.columns)}
    rest = after_scheme(F.col(held[url]))
    view = pages.toDF(*held.values()).withColumns({"host": host_of(rest), "path": path_of(rest), "node": F.when(host_of(rest) != "", address(rest))})
    spread = [held[f.name] for f in pages.schema.fields if f.name != html and isinstance(f.dataType, AtomicType)]
    linked = settle(components(edges).withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}))
    judged = settle(judge(view.select("host", "path").union(linked.select("host", "path")).distinct(), rules, broadcast_bytes))
    bad = _attach(linked, judged, ["host", "path"], "own", ["node"]).groupBy("component").agg(
        F.coalesce(F.max(F.col("own.verdict") == "block"), F.lit(False)).alias("blocked")
    )
    aliases = _attach(linked.select("node", "component"), settle(bad), ["component"], "all", ["node"])
    aliases = settle(aliases.select("node", F.col("component").alias("alias"), "all.blocked"))
    known = _attach(_attach(view, judged, ["host", "path"], "own", spread), aliases, ["node"], "other", spread)
    verdict = F.coalesce("own.verdict", F.when(F.col("other.blocked"), F.lit("block")).otherwise(otherwise))
    return known.select(
        *(F.col(c).alias(name) for name, c in held.items()), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), F.col("other.alias").alias("alias")
    )
