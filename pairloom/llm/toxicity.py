"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: density, count, variety and strength of lexicon hits, hits near second-person words, rates of
capitals, punctuation, exclamation marks, digits and obfuscated words, and length. The lexicon holds words and word
beginnings that occur far more often in labelled toxic texts than in others; obfuscated spellings are looked up in plain
letters too. Lexicon, trees and calibration are fitted on at most ``sample_rows`` labelled rows (the smallest hashes of the
id) whose crc32(id as text) mod 5 is not 0: features that the trees learn from use the lexicon of the other folds, and
the calibration uses predictions of trees that have not seen the row. Every row is then scored by its text alone.

Edge cases: null and empty texts get a score from zero features; labels without a toxic flag are left out, several labels
of a document count as toxic if one is; a null id hashes as the empty text; with fewer than ``MIN_KIND`` (20) toxic or clean
rows in the fit sample nothing is fitted: every score is the sample's share of toxic rows (0 if it is empty), so below a share
of 0.5 nothing is predicted toxic. The sample is not drawn by class, so a large corpus with under about 0.1 % toxic labels
falls under this too; of several documents with one id the text with the smallest hash is learned from, and all are scored;
very long texts are scored whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, table

SAMPLE_ROWS = 20_000
MIN_KIND = 20
FOLDS = 3
PREFIXES = (4, 5, 6)
NEAR = 5
#: Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself ye u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros vuestra vuestro".split())
#: Letters that look-alikes stand for.
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None})
_word = re.compile(r"\w(?:[\w@$*!]*\w)?")
_obfuscated = re.compile(r"[a-z][0-9@$*!]+[a-z]")
_capitals, _digits = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_marks = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_far = re.compile("[^\x00-\x7f]+")  # beyond ASCII, the same classes by category
_kinds = {c: k for c in map(chr, range(0x80, 0x20000)) if (k := {"L": 1 if c.isupper() else 0, "P": 2, "S": 2}.get(category(c)[0], 0))}
_models: dict[str, "Model"] = {}


def terms(word: str):
    """A word and its beginnings; the plain spelling's too where the word holds look-alikes."""
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "-"
    if not word.isalpha() and (plain := word.translate(PLAIN)) != word and plain.isalpha():
        yield from terms(plain)


class Lexicon:
    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 400_000:
                self.known.clear()
            got = self.known[word] = max((self.weights.get(t, 0.0) for t in terms(word)), default=0.0)
        return got

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = _word.findall(low)
        get = self.known.get
        weights = [get(w) for w in words]
        if None in weights:
            weights = [self.weight(w) if x is None else x for w, x in zip(words, weights)]
        hits = [i for i, x in enumerate(weights) if x]
        n, raw = max(1, len(words)), text.encode("utf-8", "surrogatepass")
        size = max(1, len(raw))
        found = sorted((weights[i] for i in hits), reverse=True)
        kinds = len({words[i] for i in hits})
        near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
        rate = lambda chars, more=0: (len(raw) - len(raw.translate(None, chars)) + more) / size
        kinds_beyond = [] if len(raw) == len(text) else [_kinds[c] for c in "".join(_far.findall(text)) if c in _kinds]
        capitals, marks = kinds_beyond.count(1), kinds_beyond.count(2)
        return [
            len(hits), 100 * len(hits) / n, kinds, sum(found), 100 * sum(found) / n, found[0] if found else 0.0,
            sum(found[:3]), near, 100 * near / n, np.log1p(len(words)), rate(_capitals, capitals), rate(_marks, marks),
            100 * raw.count(b"!") / n, rate(_digits), 100 * len(_obfuscated.findall(low)) / n,
        ]


class Trees:
    """Boosted regression trees of fixed depth for the log-odds, by histograms of quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.depth, self.trees = float(np.log(p / (1 - p))), depth, []
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            grad, hess = y - q, q * (1 - q)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                n = 1 << level
                best, which = np.zeros(n), [(0, bins + 1)] * n
                for j in range(x.shape[1]):
                    k = node * bins + binned[:, j]
                    g = np.bincount(k, grad, n * bins).reshape(n, bins).cumsum(1)
                    h = np.bincount(k, hess, n * bins).reshape(n, bins).cumsum(1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                    gain[(h < 2) | (total_h - h < 2)] = 0
                    at = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(n), at] > best + 1e-9):
                        best[i], which[i] = gain[i, at[i]], (j, int(at[i]))
                splits.append(which)
                feature, cut = np.array([w[0] for w in which]), np.array([w[1] for w in which])
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
            value = rate * np.bincount(node, grad, 1 << depth) / (np.bincount(node, hess, 1 << depth) + ridge)
            f += value[node]
            self.trees.append(([(np.array([w[0] for w in s]), np.array([w[1] for w in s])) for s in splits], value))

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        rows, f = np.arange(len(x)), np.full(len(x), self.base)
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (binned[rows, feature[node]] > cut[node])
            f += value[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing label shares as knots (score, share)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, t in zip(score[order], y[order]):
        blocks.append([t, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])


class Model:
    def __init__(self, weights: dict[str, float], trees: Trees | None, knots, share: float):
        self.lexicon, self.trees, self.knots, self.share = Lexicon(weights), trees, knots, share

    def __getstate__(self):
        return self.lexicon.weights, self.trees, self.knots, self.share

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, texts) -> np.ndarray:
        if self.trees is None or not len(texts):
            return np.full(len(texts), self.share)
        f = self.trees.score(np.array([self.lexicon.features(t) for t in texts], float))
        return np.clip(np.interp(f, *self.knots), 0.0, 1.0)


def _weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, names: list[str], min_rows: int = 4, least: float = 2.3) -> dict[str, float]:
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return {names[i]: float(odds[i]) for i in np.flatnonzero((toxic >= min_rows) & (odds >= least))}


def _counts(rows: DataFrame, wanted=None) -> DataFrame:
    """Rows that hold each term, by fold; wanted: a broadcast set of the only terms to count."""

    def run(frames):
        seen: dict[int, Counter] = {k: Counter() for k in range(FOLDS)}
        for frame in frames:
            for text, fold in zip(frame["text"], frame["fold"]):
                own = {t for w in set(_word.findall((text or "").lower())) for t in terms(w)}
                seen[fold].update(own if wanted is None else own & wanted.value)
            if sum(map(len, seen.values())) > 2_000_000:
                yield from ship(seen)
        yield from ship(seen)

    def ship(seen):
        for fold, counts in seen.items():
            if counts:
                yield pd.DataFrame({"term": list(counts), "fold": fold, "n": list(counts.values())})
                counts.clear()

    return rows.select("text", "fold").mapInPandas(run, "term string, fold int, n long").groupBy("term").agg(*[F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)])


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    spark = docs.sparkSession
    flagged = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = flagged.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = chosen.select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))  # a row an id: sample_rows at most
    sample = keep(rows.select("t.text", "toxic", F.pmod(F.xxhash64("t.text", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-sample")
    rows = sample.groupBy("fold").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect()
    n_toxic, n_all = np.zeros(FOLDS), np.zeros(FOLDS)
    for r in rows:
        n_toxic[r.fold], n_all[r.fold] = r.toxic, r.n
    n_clean = n_all - n_toxic
    if min(n_toxic.sum(), n_clean.sum()) < MIN_KIND:
        discard(spark, sample)
        return Model({}, None, None, float(n_toxic.sum() / n_all.sum()) if n_all.sum() else 0.0)
    total = sum((F.col(f"n{k}") for k in range(FOLDS)), F.lit(0))
    toxic = _counts(sample.filter("toxic = 1")).filter(total >= 4).toPandas().sort_values("term")
    names = toxic["term"].tolist()
    t = toxic[[f"n{k}" for k in range(FOLDS)]].to_numpy(float)
    sent = spark.sparkContext.broadcast(frozenset(names))
    clean = _counts(sample.filter("toxic <> 1"), sent).toPandas().set_index("term").reindex(names).fillna(0)
    c = clean[[f"n{k}" for k in range(FOLDS)]].to_numpy(float)
    whole = _weights(t.sum(1), c.sum(1), n_toxic.sum(), n_clean.sum(), names)
    others = [[j for j in range(FOLDS) if j != k] for k in range(FOLDS)]
    by_fold = [_weights(t[:, o].sum(1), c[:, o].sum(1), n_toxic[o].sum(), n_clean[o].sum(), names, 3) for o in others]
    lexicons = spark.sparkContext.broadcast(by_fold)

    def featurise(frames):
        own = [Lexicon(w) for w in lexicons.value]
        for frame in frames:
            x = [own[f].features(s) for s, f in zip(frame["text"], frame["fold"])]
            yield pd.DataFrame({"x": x, "toxic": frame["toxic"], "fold": frame["fold"]})

    table_ = sample.mapInPandas(featurise, "x array<double>, toxic int, fold int").toPandas()
    x, y, fold = np.array(table_["x"].tolist(), float), table_["toxic"].to_numpy(float), table_["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the same fit however rows were dealt
    x, y, fold = x[order], y[order], fold[order]
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            unseen[fold == k] = Trees(x[fold != k], y[fold != k]).score(x[fold == k])
    model = Model(whole, Trees(x, y), isotonic(unseen, y), float(y.mean()))
    discard(spark, sample)
    return model


def scorer(spark, model: Model):
    """A column function: text -> score, 0 to 1."""
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        if name not in _models:
            _models.clear()
            _models[name] = sent.value
        return pd.Series(_models[name].score(texts.tolist()))

    return F.pandas_udf(score, "double").asNondeterministic()  # run once, wherever its value is used


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(spark, fit(docs, table(spark, sf_dir, "labels")))
    out = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go.

    A null or empty text is scored like any other; repeated rows share their fate; other columns pass unchanged; no documents give none.
    """
    score = scorer(spark, fit(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score("text") < 0.5)
