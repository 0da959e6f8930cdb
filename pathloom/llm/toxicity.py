"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features are taken from the whole text only: densities of lexicon words, their share
near second-person pronouns, capitals, punctuation and obfuscation (words spelt with
digits, signs, gaps or stretched letters), and densities of learned words. The trees are
fitted on the driver from a sample of labelled rows of at most `most` rows (default
SAMPLE_ROWS), chosen by a hash of the id; rows whose crc32(doc_id as text) mod 3 is 1
never enter it. Scores are calibrated by isotonic regression on out-of-fold margins, so
that a score is a probability.

Learned words, and beginnings of words (of BEGINNINGS letters), are those that stand in a
larger share of the sample's toxic documents than of its clean ones, by a bound of
DEVIATIONS. They are counted on the executors; for the
rows of a fold of the sample they are learned from the other folds, so that the trees see
densities as they are on documents that the words weren't learned from.

Very long texts are read whole; of rows with one score (a tie) each gets it. Null and empty texts have all densities 0 and get the score of that feature vector.
Repeated rows are scored alike; a doc_id that has several labels counts as toxic if one
of them says so; null labels and ids aren't learned from. With no label of one class,
every score is the share of toxic labels (0 with no labels at all). An empty table gives
an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, held_out, materialise, slices

#: Labelled rows that the trees are fitted on, at most.
SAMPLE_ROWS = 20_000
#: A score of this or more is toxic.
THRESHOLD = 0.7
#: Parts of the sample; margins and learned words of each come from the others.
FOLDS = 4
#: Learned words: at most so many, each in so many toxic documents at least, and so many deviations by which the logarithm of the ratio of shares is lowered.
LEARNED, LEAST, DEVIATIONS = 20_000, 3, 2.0
#: Letters of the beginnings of longer words that are learned like words; they end in a star.
BEGINNINGS = (4, 5, 6)

# Words of four languages in the order insult, profanity, threat and contempt. Words that are harmless in another of the languages are left out.
LEXICON = {
    "insult": """idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbeciles fool fools foolish loser losers clown clowns scum trash garbage
        worthless pathetic disgusting vermin filth filthy pig pigs rat rats freak freaks creep creeps coward cowards liar liars jerk jerks dimwit halfwit
        cretin lowlife scumbag parasite brainless useless repulsive retard retarded dummkopf trottel depp blöd idioten abschaum müll widerlich
        dumm wertlos imbécile crétin débile abruti ordure minable dégoûtant nul stupide inutil estúpido estúpida imbécil tonto tonta basura asqueroso patético payaso escoria""",
    "profanity": """fuck fucks fucking fucked fucker motherfucker shit shits shitty bullshit bitch bitches bastard bastards asshole assholes ass arse dick dickhead cunt
        cock prick piss crap damn goddamn hell whore slut wanker bollocks scheisse scheiße arschloch hurensohn fotze wichser merde putain connard salope
        enculé mierda puta puto cabrón pendejo coño joder gilipollas""",
    "threat": """kill kills killing dead murder hurt beat punch stab shoot burn hang rape destroy suffer töten sterben umbringen stirb crève mourir
        matar muere morir""",
    "contempt": """hate hates hated despise despicable ugly disgrace sickening shut stfu loathe inferior subhuman animal animals hasse hässlich hais déteste laid odio feo""",
}
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur ya du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Digits and signs that stand for letters.
DISGUISES = str.maketrans("013457@$!|€", "oieastasiie")
#: Words within this distance of a pronoun are near it.
NEAR = 5
FEATURES = [*LEXICON, "hits", "log_hits", "near_pronoun", "pronouns", "capitals", "shouted", "exclaimed", "asked", "punctuation", "obfuscated", "log_obfuscated", "disguised", "stretched", "log_words", *(f"{k}_{of}" for of in ("words", "beginnings") for k in ("learned", "log_learned", "learned_weight", "log_learned_weight"))]

_groups = {w: i for i, words in enumerate(LEXICON.values()) for w in words.split()}
_words = re.compile(r"[^\W_]+").findall
_disguised = re.compile(r"(?<![\w@$!|*])(?=\S{0,24}?[0-9@$!|*€])[^\W\d_][\w@$!|*€]{2,24}|(?<![\w@$!|*])[0-9@$|€][^\W_]*[^\W\d_][\w@$!|*€]{1,24}").findall
_spaced = re.compile(r"(?<![^\W_])[^\W\d_](?:([.\-_* ])[^\W\d_])(?:\1[^\W\d_]){1,12}(?![^\W_])")
_stretched = re.compile(r"\b\w*?([^\W\d_])\1{2,}\w*").finditer
_runs = re.compile(r"(.)\1+")
#: What a text with disguised or stretched words must hold.
_sign, _triple = re.compile(r"[0-9@$!|*€]").search, re.compile(r"(\w)\1\1").search
_starred = [(w, re.compile("^" + "".join(c if i == 0 else f"[{re.escape(c)}*]" for i, c in enumerate(w)) + "$")) for w in _groups if len(w) > 3]
_starred_by: dict[tuple[str, int], list] = {}
for _w, _p in _starred:
    _starred_by.setdefault((_w[0], len(_w)), []).append((_groups[_w], _p))


def _undone(word: str) -> int | None:
    """The group of the lexicon word that a disguised spelling stands for."""
    word = bare if (bare := word.rstrip("!|*")).isalnum() else word
    if word in _groups:
        return None  # spelt openly; counted as a word
    undone = word.translate(DISGUISES)
    for x in (undone, _runs.sub(r"\1", undone)):
        if x in _groups:
            return _groups[x]
    return next((g for g, p in _starred_by.get((word[0], len(word)), ()) if p.match(word)), None) if "*" in word else None


def beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in BEGINNINGS if len(word) > k]


class Weights(dict):
    """Of each word looked up: the weight that was learned for it and the greatest of its beginnings', None without either; half a million words are remembered."""

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned = learned

    def __missing__(self, word: str) -> tuple[float, float] | None:
        if len(self) > 500_000:
            self.clear()
        found = self.learned.get(word, 0.0), max((self.learned.get(b, 0.0) for b in beginnings(word)), default=0.0)
        self[word] = found = found if any(found) else None
        return found


def features(text: str | None, weights: Weights | None = None) -> list[float]:
    """weights: of learned words."""
    text = text or ""
    lower = text.lower()
    words = _words(lower)
    n = max(1, len(words))
    groups = [0] * len(LEXICON)
    at = [i for i, w in enumerate(words) if w in _groups]
    for i in at:
        groups[_groups[words[i]]] += 1
    pronouns = sum(map(SECOND_PERSON.__contains__, words))
    near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in at) if pronouns else 0
    disguised = [w for w in _disguised(lower) if not w.isdigit()] if _sign(lower) else []
    stretched = [m[0] for m in _stretched(lower)] if _triple(lower) else []
    found = [*map(_undone, disguised), *(_groups.get("".join(c for c in m[0] if c not in ".-_* ")) for m in _spaced.finditer(lower))]
    found += [_groups.get(_runs.sub(r"\1", w), _groups.get(_runs.sub(r"\1\1", w))) for w in stretched if w not in _groups]
    obfuscated = 0
    for g in found:  # a disguised word counts as the word that it stands for, and as disguised
        if g is not None:
            groups[g] += 1
            obfuscated += 1
    letters = max(1, len(text))
    upper = sum(map(str.isupper, text)) if text != lower else 0
    shouted = sum(len(w) > 2 and w.isupper() for w in _words(text)) if upper > len(words) else 0
    signs = {c: text.count(c) for c in "!?.,;:#$%&*"}
    hits = sum(groups)
    found = [x for x in map(weights.__getitem__, words) if x] if weights is not None and weights.learned else []
    marks: list[float] = []
    for own in ([a for a, _ in found if a], [b for _, b in found if b]):
        weight = math.fsum(own)
        marks += [1000 * len(own) / n, math.log1p(len(own)), 1000 * weight / n, math.log1p(weight)]
    return [
        *(1000 * g / n for g in groups), 1000 * hits / n, math.log1p(hits), 1000 * near / n, 1000 * pronouns / n,
        upper / letters, shouted / n, signs["!"] / n, signs["?"] / n, sum(signs.values()) / letters, 1000 * obfuscated / n, math.log1p(obfuscated), len(disguised) / n, len(stretched) / n, math.log1p(len(words)),
        *marks,
    ]


class Trees:
    """Boosted regression trees of the logistic loss over binned features."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, least: float = 2.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start = math.log(share / (1 - share))
        self.edges = [np.unique(np.quantile(np.concatenate([c, c[c > 0]]), np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        margin = np.full(len(y), self.start)
        # a tree as arrays over its nodes in heap order: feature (-1: leaf), bin, value
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, at = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][at]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        at = np.zeros(len(g), int)
        for node in range(size):
            own = np.flatnonzero(at == node)
            if not len(own):
                continue
            gs, hs = g[own], h[own]
            G, H = gs.sum(), hs.sum()
            value[node] = -self.rate * G / (H + self.ridge)
            if 2 * node + 2 >= size:
                continue
            best = 1e-6
            for j in range(binned.shape[1]):
                width = len(self.edges[j]) + 1
                gl = np.cumsum(np.bincount(binned[own, j], gs, width))[:-1]
                hl = np.cumsum(np.bincount(binned[own, j], hs, width))[:-1]
                ok = (hl >= self.least) & (H - hl >= self.least)
                if not ok.any():
                    continue
                gain = np.where(ok, gl**2 / (hl + self.ridge) + (G - gl) ** 2 / (H - hl + self.ridge) - G**2 / (H + self.ridge), 0)
                if gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), j, int(gain.argmax())
            if feature[node] >= 0:
                at[own] = 2 * node + 1 + (binned[own, feature[node]] > cut[node])
        return (feature, cut, value), at

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (binned[rows, np.maximum(f, 0)] > cut[at]), at)
            out += value[at]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function of least squared error, as block means at the blocks' mean x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, of x, count
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, a, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            s, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + t, blocks[-1][2] + n]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


class Model:
    """Trees and their calibration. constant: the score where there is nothing to learn from. learned: weights of learned words, for features()."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, learned: dict[str, float]):
        self.constant, self.learned = float(y.mean()) if len(y) else 0.0, learned
        self.trees = None
        if len(y) < 2 * FOLDS or y.min() == y.max() or fold.min() == fold.max():
            return
        margins = np.zeros(len(y))
        for own in np.unique(fold):
            left = fold == own
            margins[left] = Trees().fit(x[~left], y[~left]).margin(x[left])
        # two rows of either outcome keep the ends of the scale off 0 and 1
        ends = [margins.min(), margins.max()] * 2
        self.at, self.level = isotonic(np.concatenate([margins, ends]), np.concatenate([y, [1, 0, 0, 1]]))
        self.trees = Trees().fit(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.constant)
        return np.interp(self.trees.margin(x), self.at, self.level)


def learn(texts: DataFrame) -> list[dict[str, float]]:
    """Weights of the words of texts(doc_id, t, toxic, fold) that mark toxic documents: without each fold's rows, then from all rows."""
    cells = [f"n{fold}_{toxic}" for fold in range(FOLDS) for toxic in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            counts: dict[str, list[int]] = {}
            for t, toxic, fold in zip(*(batch.column(k).to_pylist() for k in ("t", "toxic", "fold")), strict=True):
                words = set(_words(t.lower()))
                for w in words.union(*map(beginnings, words)):
                    counts.setdefault(w, [0] * len(cells))[2 * fold + toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([n[k] for n in counts.values()], pa.int64()) for k in range(len(cells)))], ["word", *cells])

    total = {(r.fold, r.toxic): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    words = texts.mapInArrow(run, ", ".join(["word string", *(f"{k} long" for k in cells)])).groupBy("word").agg(*(F.sum(k).alias(k) for k in cells))

    def weight(without: int | None) -> Column:
        folds = [fold for fold in range(FOLDS) if fold != without]
        clean, toxic = (sum((F.col(f"n{fold}_{k}") for fold in folds), F.lit(0.5)) for k in (0, 1))
        all_clean, all_toxic = (sum(total.get((fold, k), 0) for fold in folds) + 1 for k in (0, 1))
        least = F.log(toxic / all_toxic) - F.log(clean / all_clean) - DEVIATIONS * F.sqrt(1 / toxic + 1 / clean)
        return F.when((toxic > LEAST) & (least > 0), least).otherwise(0.0)

    weights = [weight(fold) for fold in [*range(FOLDS), None]]
    found = words.select("word", *(w.alias(f"w{i}") for i, w in enumerate(weights))).withColumn("best", F.greatest(*(f"w{i}" for i in range(len(weights))))).where("best > 0")
    rows = found.orderBy(F.desc("best"), "word").limit(LEARNED).collect()
    return [{r.word: r[f"w{i}"] for r in rows if r[f"w{i}"] > 0} for i in range(len(weights))]


def sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, float]]:
    """Features, labels and folds of at most `most` labelled documents that aren't held out, in the order of a hash of the id, and the words learned from all of them."""
    bounded_batches(documents)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id")).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # the broadcast is of `most` ids at the largest
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(few), "doc_id")
    # a doc_id that repeats counts once; only the sample's texts are shuffled
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("t", "toxic")).alias("r")).select("doc_id", "r.*", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    texts = materialise(texts, "sample")
    *others, learned = learn(texts)
    shared = documents.sparkSession.sparkContext.broadcast(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [Weights(x) for x in shared.value]
        for batch in slices(batches, "t"):
            x = [features(t, weights[fold]) for t, fold in zip(batch.column("t").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "toxic", "fold")), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    rows = texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, toxic int, fold int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id").select("x", "toxic", "fold").toArrow()
    discard(texts)
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return x, np.array(rows.column("toxic").to_pylist(), float), np.array(rows.column("fold").to_pylist(), int), learned


def score(documents: DataFrame, model: Model, keep: list[str], text: str = "text", below: float | None = None) -> DataFrame:
    """Columns `keep` and toxic_score of every row; with `below`, of the rows that score less, without toxic_score."""
    bounded_batches(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    inner = [f"k{i}" for i in range(len(keep))]
    source = documents.select(*[F.col(k).alias(i) for k, i in zip(keep, inner, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("t"))
    types = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(shared.value.learned)
        for batch in slices(batches, "t"):
            found = shared.value.score(np.array([features(t, weights) for t in batch.column("t").to_pylist()], float))
            out = pa.RecordBatch.from_arrays([*[batch.column(i) for i in inner], pa.array(found, pa.float64())], [*inner, "toxic_score"])
            yield out if below is None else out.filter(pa.array(found < below))

    out = source.mapInArrow(run, ", ".join([*[f"{i} {types[i]}" for i in inner], "toxic_score double"]))
    out = out if below is None else out.select(*inner)
    return out.withColumnsRenamed(dict(zip(inner, keep, strict=True)))


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    return Model(*sample(documents, labels, most))
