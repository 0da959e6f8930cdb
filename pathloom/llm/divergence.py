"""How the sources of a language differ in their words, exactly.

Occurrences and documents are counted by (language, source, term) before and after the shuffle. A term that enough
documents of its language hold becomes one row with its counts by source, the wide vector. Languages
carry the list of their sources with the sources' totals; a term's vector is laid out along that list by higher-order
functions, which also emit the contribution of each pair of sources. Contributions are summed before they are shuffled.

A hot source or word is a row for each task. Rows of terms meet their language's row under a salt of
the term, since a language may hold most terms. A vector is as long as its language has sources; the result has all pairs of
these. Shares are integers of a billion, divided in decimals, so nothing is rounded and sums don't depend on their order.

Null text, language and source are ''. Repeated rows are documents of their own. A text of any length is one row's words. Ties in a
ranking go to the item that is smaller in UTF-8. A language without kept terms has pairs of value 0; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import best, group
from .common import compact, materialise

#: What stands between terms: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that hold a kept term at least; added to every count; parts of a share; ranks of terms.
MIN_DOCS, SMOOTH, PARTS, RANKS = 30, 5, 1_000_000_000, 50
#: Rows of a language, each meets a part of the terms.
SALTS = 64


def counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it)."""
    empty = F.lit("")
    words = F.split(F.translate(F.coalesce(F.col(text), empty), string.ascii_uppercase, string.ascii_lowercase), BETWEEN)
    rows = df.select(F.coalesce(F.col(lang), empty).alias("lang"), F.coalesce(F.col(source), empty).alias("source"), words.alias("words"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = F.inline(F.array(F.struct(F.col("words").alias("of"), one.alias("n"), zero.alias("docs")), F.struct(F.array_distinct("words").alias("of"), zero.alias("n"), one.alias("docs"))))
    return rows.select("lang", "source", both).select("lang", "source", F.explode("of").alias("term"), "n", "docs").where("term <> ''").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> str:
    """SQL of a smoothed share in parts, from 1; v: the number of kept terms."""
    return f"1 + (CAST({count} + {SMOOTH} AS DECIMAL(20, 0)) * {PARTS}) div ({total} + {SMOOTH} * v)"


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", best(group("lang", "source"), F.desc("value"), F.col("item")))


@compact
def audit(df: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value and rank: by `pair` the distance to each other source of the language, by `term` the terms of which a source has most beyond its language."""
    empty = F.lit("")
    groups = df.select(F.coalesce(F.col(lang), empty).alias("lang"), F.coalesce(F.col(source), empty).alias("source")).distinct()
    counted = counts(df, lang, source, text)
    by_source = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    wide = materialise(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), by_source.alias("by")).where(F.col("docs") >= min_docs).select("lang", "term", "n", "by"), "terms")

    totals = wide.select("lang", F.explode("by").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    zero = F.lit(0).cast("long")
    sources = groups.join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", zero).alias("total")).alias("s"))
    langs = sources.groupBy("lang").agg(F.array_sort(F.collect_list("s")).alias("sources")).join(kept, "lang", "left")
    langs = materialise(langs.select("lang", "sources", F.coalesce("v", zero).alias("v"), F.coalesce("all", zero).alias("all")), "languages")

    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = wide.withColumn("salt", salt("term")).join(salted, ["lang", "salt"])
    own = F.expr(f"transform(sources, s -> {share('coalesce(try_element_at(by, s.source), 0L)', 's.total')})")
    vectors = materialise(met.select("lang", "term", "by", F.transform("sources", lambda s: s["source"]).alias("names"), own.alias("p"), F.expr(share("n", "all")).alias("q")), "vectors")

    return _pairs(vectors, langs).unionByName(_terms(vectors, ranks))


def _pairs(vectors: DataFrame, langs: DataFrame) -> DataFrame:
    def others(i: Column) -> Column:
        """Contributions of source i with each after it."""
        rest = F.slice(F.col("p"), i + 2, F.size("p"))
        return F.transform(rest, lambda x, j: F.struct(i.alias("i"), (i + j + 1).alias("j"), F.abs(F.get("p", i) - x).alias("f")))

    emitted = vectors.where(F.size("p") > 1).select("lang", F.inline(F.flatten(F.transform("p", lambda _, i: others(i)))))
    sums = emitted.groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    names = langs.select("lang", F.transform("sources", lambda s: s["source"]).alias("names"))
    every = names.select("lang", "names", F.posexplode("names").alias("i", "source")).select("lang", "i", "source", F.posexplode("names").alias("j", "item")).where("i <> j")
    told = every.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return ranked(told)


def _terms(vectors: DataFrame, ranks: int) -> DataFrame:
    each = vectors.select("lang", F.col("term").alias("item"), "by", "q", F.inline(F.arrays_zip(F.col("names").alias("source"), F.col("p").alias("own"))))
    more = each.where("own > q and map_contains_key(by, source)").select("lang", "source", F.lit("term").alias("part"), "item", (F.col("own") - F.col("q")).alias("value"))
    return ranked(more).where(F.col("rank") <= ranks)
