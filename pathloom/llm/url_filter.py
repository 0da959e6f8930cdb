"""URL filters by a tree of path templates.

Rules decide the pages that they fit and label them. All pages, with their labels, make a tree for each host: a level
for each segment of the path, built from the top for all hosts at once. At a node a segment that at least SUPPORT
pages and one in MOST of the node's pages have stays as it is; all others become a wildcard of their kind, so
that a node has at most MOST and a few branches. Branches that are statistically alike are merged: what follows them is
distributed alike, and so are their labels, by Hoeffding's bound, and most labels say the same (few labels differ by no bound);
a branch without labels only joins others without.
What a page's path generalises to is its template.

The share of rejected pages among a template's labelled ones, smoothed towards its parent's share, is its purity; a host's is
smoothed towards that of all labels. Pages that no rule decides are blocked if the purity of their template is
REJECT or more.

Pages are counted by (host, path) first, and a level's counts by (host, node, segment), both before and after the
shuffle; rows meet the branch of their segment under the same key, so a host with most of the pages is dealt out. A node's
branches are merged in one row of bounded length by higher-order functions. Each level is a table in the shared folder; levels end
with the longest path, at DEPTH segments at most: the last one is all that is left of a path, so whole paths count.

Null urls and urls without "://" have an empty host and path, which is a host like others. Repeated rows count
as often as they occur; a page_id may repeat or be null. Branches of equal weight are merged in the order of their names. Without labels
nothing is blocked; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compact, materialise

#: Pages that keep a segment from becoming a wildcard: so many, and one in so many of its node's.
SUPPORT, MOST = 8, 32
#: Levels of a tree.
DEPTH = 8
#: The chance that branches that are alike are told apart by one of the tests.
ALPHA = 0.05
#: Labelled pages that a parent's share counts for; the purity from which on a template is rejected.
WEIGHT, REJECT = 4.0, 0.8


class Rule(NamedTuple):
    """text: a host and, from its first slash on, the start of a path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


RULES = (Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block"))


def parts(url: str) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """Number of the longest rule that fits, null if none does. A list of rules is one expression: tens, not millions."""
    found = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i].text), i)):  # the longest is asked first
        fits = ((host == rules[i].host) | host.endswith("." + rules[i].host)) & path.startswith(rules[i].path)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


#: Kinds of what follows a branch: nothing, an empty segment, digits, letters, digits with an ending, others.
KINDS = ("end", "empty", "digits", "letters", "file", "other")


def kind(segment: Column) -> Column:
    """Position in KINDS; null is no segment."""
    out = F.lit(5)
    for i, pattern in ((4, r"^[0-9]+\.[A-Za-z]+\z"), (3, r"^\p{L}+\z"), (2, r"^[0-9]+\z"), (1, r"^\z")):
        out = F.when(segment.rlike(pattern), F.lit(i)).otherwise(out)
    return F.when(segment.isNull(), F.lit(0)).otherwise(out)


def alike(a: Column, b: Column) -> Column:
    """Whether two branches (n, good, bad, follows) are distributed alike, by their followers and labels."""
    bound = math.sqrt(math.log(2 / ALPHA) / 2)

    def near(x: Column, n: Column, y: Column, m: Column) -> Column:
        return F.abs(x / n - y / m) <= bound * (1 / F.sqrt(n) + 1 / F.sqrt(m))

    followers = F.forall(F.zip_with(a["follows"], b["follows"], lambda x, y: near(x, a["n"], y, b["n"])), lambda ok: ok)
    of_a, of_b = a["good"] + a["bad"], b["good"] + b["bad"]
    lean = (2 * a["bad"] >= of_a) == (2 * b["bad"] >= of_b)
    labels = F.when((of_a == 0) | (of_b == 0), of_a == of_b).otherwise(lean & near(a["bad"], of_a, b["bad"], of_b))
    return followers & labels


def merged(branches: Column) -> Column:
    """Branches in order, each added to the first merged one that is like it, or else one of its own."""

    def add(a: Column, b: Column) -> Column:
        return F.struct(
            F.concat(a["names"], b["names"]).alias("names"), (a["n"] + b["n"]).alias("n"), (a["good"] + b["good"]).alias("good"), (a["bad"] + b["bad"]).alias("bad"),
            F.zip_with(a["follows"], b["follows"], lambda x, y: x + y).alias("follows"),
        )

    def step(held: Column, x: Column) -> Column:
        to = F.array_position(F.transform(held, lambda h: alike(h, x)), True)
        return F.when(to == 0, F.concat(held, F.array(x))).otherwise(F.transform(held, lambda h, i: F.when(i + 1 == to, add(h, x)).otherwise(h)))

    return F.aggregate(F.slice(branches, F.lit(2), F.size(branches)), F.slice(branches, F.lit(1), F.lit(1)), step)


def _grow(rows: DataFrame, depth: int) -> DataFrame:
    """rows (host, path, n, good, bad, segments, node, purity) with the node of each at the next depth."""
    segment, after = F.get("segments", F.lit(depth)), F.get("segments", F.lit(depth + 1))
    here = rows.where(F.size("segments") > depth).select("host", "node", "purity", segment.alias("segment"), "n", "good", "bad", kind(after).alias("next"))
    follows = [F.sum(F.when(F.col("next") == i, F.col("n")).otherwise(0)).alias(f"f{i}") for i in range(len(KINDS))]
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    counted = materialise(here.groupBy("host", "node", "segment").agg(*sums, F.first("purity").alias("purity"), *follows), "segments")
    totals = counted.groupBy("host", "node").agg(F.sum("n").alias("total"))
    stays = (F.col("segment") == "") | ((F.col("n") >= SUPPORT) & (F.col("n") * MOST >= F.col("total")))
    wildcards = F.array(*(F.lit(f"*{k}") for k in KINDS))
    branch = F.when(stays, F.concat(F.lit("="), F.col("segment"))).otherwise(F.get(wildcards, kind(F.col("segment"))))
    of = materialise(counted.join(totals, ["host", "node"]).withColumn("branch", branch), "branches")
    again = [F.sum(f"f{i}").alias(f"f{i}") for i in range(len(KINDS))]
    each = of.groupBy("host", "node", "branch").agg(*sums, F.first("purity").alias("purity"), *again)
    one = F.struct((-F.col("n")).alias("order"), "branch", "n", "good", "bad", F.array(*(f"f{i}" for i in range(len(KINDS)))).alias("follows"))
    nodes = each.groupBy("host", "node").agg(F.array_sort(F.collect_list(one)).alias("branches"), F.first("purity").alias("purity"))
    clean = F.transform("branches", lambda b: F.struct(F.array(b["branch"]).alias("names"), b["n"].alias("n"), b["good"].alias("good"), b["bad"].alias("bad"), b["follows"].alias("follows")))
    groups = nodes.select("host", "node", "purity", F.explode(merged(clean)).alias("g"))
    name = F.concat(F.col("node"), F.lit("/"), F.array_join(F.array_sort("g.names"), "|"))
    purity = (F.col("g.bad") + WEIGHT * F.col("purity")) / (F.col("g.good") + F.col("g.bad") + WEIGHT)
    children = groups.select("host", "node", F.explode("g.names").alias("branch"), name.alias("child"), purity.alias("child_purity"))
    mapped = of.select("host", "node", "segment", "branch").join(children, ["host", "node", "branch"]).select("host", "node", "segment", "child", "child_purity")
    onward = rows.withColumn("segment", segment).join(mapped, ["host", "node", "segment"], "left")
    return onward.select("host", "path", "n", "good", "bad", "segments", F.coalesce("child", "node").alias("node"), F.coalesce("child_purity", "purity").alias("purity"))


@compact
def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), template, purity and labelled (by a rule or a label) of every page.

    labels: page_id and verdict of pages that are labelled besides, one row a page; a rule's verdict counts before it.
    """
    host, path = parts(url)
    pages = df.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    texts, verdicts = (F.array(*(F.lit(getattr(r, f)) for r in rules)).cast("array<string>") for f in ("text", "verdict"))
    number = fitting(rules, F.col("host"), F.col("path"))
    told = pages.withColumn("number", number).select("page_id", "host", "path", F.get(texts, F.col("number")).alias("rule"), F.get(verdicts, F.col("number")).alias("verdict"))
    told = told.withColumn("label", F.col("verdict"))
    if labels is not None:
        told = told.join(labels.select("page_id", F.col("verdict").alias("given")), "page_id", "left").withColumn("label", F.coalesce("label", "given")).drop("given")
    told = materialise(told, "pages", scanned=True)

    has = lambda v: F.when(F.col("label") == v, 1).otherwise(0)
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", DEPTH)
    counted = told.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(has("allow")).alias("good"), F.sum(has("block")).alias("bad"))
    counted = materialise(counted.withColumn("segments", segments), "paths")
    g, b = F.col("good"), F.col("bad")
    prior = counted.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).select(F.when(g + b > 0, b / (g + b)).otherwise(F.lit(0.0)).alias("prior"))
    hosts = counted.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(prior))  # one row
    roots = hosts.select("host", ((b + WEIGHT * F.col("prior")) / (g + b + WEIGHT)).alias("purity"))
    rows = materialise(counted.join(roots, "host").withColumn("node", F.lit("")), "nodes")
    for depth in range(rows.agg(F.max(F.size("segments"))).first()[0] or 0):
        rows = materialise(_grow(rows, depth), "nodes")
    of_path = rows.select("host", "path", F.col("node").alias("template"), "purity")
    verdict = F.coalesce("label", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return told.join(of_path, ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity", F.col("label").isNotNull().alias("labelled"))
