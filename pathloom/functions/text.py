"""Tokenizers, answer parsers and answer matching as Column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ten node types, in the order in which an answer type is looked for.
NODE_TYPES = ["drug", "gene/protein", "disease", "effect/phenotype", "anatomy", "biological_process", "cellular_component", "exposure", "molecular_function", "pathway"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nonempty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def unicode_tokens(text: Column | str) -> Column:
    """Runs of letters, digits and underscores of any script, lower-cased."""
    return _nonempty(F.split(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_]+", " "), " "))


def ascii_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("([a-z0-9]+)"), F.lit(1))


def space_tokens(text: Column | str) -> Column:
    """Pieces between single spaces, empty ones too, case kept."""
    return F.split(_col(text), " ")


def whitespace_tokens(text: Column | str) -> Column:
    return _nonempty(F.split(F.lower(_col(text)), r"\s+"))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def braced(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"\{([^}]+)\}"), F.lit(1))


def final_answer(text: Column | str) -> Column:
    """The first braced part; the second, if the first is yes or no and there is one; '' without any."""
    found = braced(text)
    verdict = strip(F.lower(F.get(found, F.lit(0)))).isin("yes", "no")
    return F.coalesce(strip(F.when((F.size(found) >= 2) & verdict, F.get(found, F.lit(1))).otherwise(F.get(found, F.lit(0)))), F.lit(""))


def reasoning_answer(text: Column | str) -> Column:
    """What stands between the first opening and the first closing brace; '' if either is missing or they are out of order."""
    t = _col(text)
    start, end = F.locate("{", t), F.locate("}", t)
    return F.coalesce(F.when((start > 0) & (end > start), strip(F.substring(t, start + 1, end - start - 1))), F.lit(""))


def normal(text: Column | str) -> Column:
    """Stripped, without inner spaces, lower-cased."""
    return F.lower(F.replace(strip(text), F.lit(" "), F.lit("")))


def answer_matches(response: Column | str, name: Column | str) -> Column:
    """Equal or one within the other once normalised. An answer that is empty after normalising matches nothing."""
    a, b = normal(response), normal(name)
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def says_yes(text: Column | str) -> Column:
    return F.coalesce(normal(text) == "yes", F.lit(False))


def score_list(text: Column | str, n: Column | str) -> Column:
    """All decimal numbers of a text, if there are n; else n times 1/n. Integers are not scores."""
    n = _col(n)
    found = F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"(\d+\.\d+)"), F.lit(1)), lambda x: x.cast("double"))
    return F.when(F.size(found) == n, found).otherwise(F.array_repeat(F.lit(1.0) / n, n))


def relation_scores(text: Column | str, known: Column | str) -> Column:
    """array<struct<relation, score>> of items "{relation (Score: x)}" whose relation is known; null if there are none."""
    t, pattern = F.coalesce(_col(text), F.lit("")), r"\{\s*([^()]+)\s+\(Score:\s+([0-9.]+)\)\}"
    names = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), strip)
    scores = F.regexp_extract_all(t, F.lit(pattern), F.lit(2))
    pairs = F.zip_with(names, scores, lambda r, s: F.struct(r.alias("relation"), s.try_cast("double").alias("score")))
    kept = F.filter(pairs, lambda p: ~F.contains(p["relation"], F.lit(";")) & F.array_contains(_col(known), p["relation"]) & p["score"].isNotNull())
    return F.when(F.size(kept) > 0, kept)


def json_list(text: Column | str) -> Column:
    """The first bracketed part as a JSON list of strings; empty if there is none or it does not parse."""
    return F.coalesce(F.from_json(F.regexp_extract(_col(text), r"(?s)\[.*?\]", 0), "array<string>"), F.array().cast("array<string>"))


def subquery(text: Column | str) -> Column:
    """struct<subquery, target_type> of the first braced JSON object without braces inside; nulls where it has none."""
    parsed = F.from_json(F.regexp_extract(_col(text), r"(?s)\{[^{}]*\}", 0), "subquery string, target_type string")
    return F.struct(*[F.nullif(strip(parsed[k]), F.lit("")).alias(k) for k in ("subquery", "target_type")])


def without_choices(text: Column | str) -> Column:
    """A question without its block of choices A to D."""
    t = _col(text)
    cut = F.regexp_replace(t, r"(?s)\nA: [^\n]+\nB: [^\n]+\nC: [^\n]+\nD: .*$", "")
    return F.when(cut == t, t).otherwise(strip(cut))


def answer_type(text: Column | str, types: list[str] = NODE_TYPES) -> Column:
    """The first of the types, in their order, that a response mentions."""
    lower = F.lower(_col(text))
    return F.get(F.filter(F.array(*map(F.lit, types)), lambda t: F.contains(lower, t)), F.lit(0))


def first_hop(text: Column | str, available: Column | str) -> Column:
    """The first digit that is one of the available hops."""
    digits = F.transform(F.regexp_extract_all(_col(text), F.lit("([0-9])"), F.lit(1)), lambda d: d.cast("int"))
    return F.get(F.filter(digits, lambda d: F.array_contains(_col(available), d)), F.lit(0))


def sentences(text: Column | str) -> Column:
    """Pieces between ". " (line ends count as such), stripped, of more than ten characters."""
    pieces = F.transform(F.split(F.replace(_col(text), F.lit("\n"), F.lit(". ")), r"\. "), strip)
    return F.filter(pieces, lambda s: F.length(s) > 10)


def chunks(text: Column | str, most: int = 150, least: int = 50) -> Column:
    """Clauses between '.' or ';' and white space; longer than `most` they are cut before the last ", " within `most` characters, or at `most` if that leaves less than `least`.

    A piece that is cut off is stripped; what remains loses commas and spaces at both ends, so that only the first cut sees those at the clause's end.
    """
    clauses = F.filter(F.transform(F.split(_col(text), r"(?U)(?<=[.;])\s+"), strip), lambda s: s != "")
    part = rf".{{{least},{most - 2}}}(?=, )|.{{{most}}}"

    def cut(s: Column) -> Column:
        head = F.regexp_extract(s, rf"(?s)^(?:{part})", 0)
        rest = F.btrim(F.substring(s, F.length(head) + 1, F.length(s)), F.lit(", "))
        # the last piece is what is left, as it is
        pieces = F.regexp_extract_all(rest, F.lit(rf"(?s)[, ]*+(.{{1,{most}}}\z|{part})"), F.lit(1))
        last = F.size(pieces) - 1
        stripped = F.transform(pieces, lambda x, i: F.when(i < last, strip(x)).otherwise(x))
        return F.when(F.length(s) <= most, F.array(s)).otherwise(F.concat(F.array(strip(head)), F.filter(stripped, lambda x: x.isNotNull())))

    return F.flatten(F.transform(clauses, cut))


def first_mentioned(text: Column | str, names: Column | str) -> Column:
    """The first name, in list order, that a text contains in any case; the first of all if it contains none."""
    lower = F.lower(_col(text))
    names = _col(names)
    return F.coalesce(F.get(F.filter(names, lambda n: F.contains(lower, F.lower(n))), F.lit(0)), F.get(names, F.lit(0)))
