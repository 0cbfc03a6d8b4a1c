"""Toxicity by non-negative positive-unlabelled learning in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.ship import ship

from .common import map_text, slices

#: About how many confirmed toxic texts, and unlabelled texts, the learner's steps see. What a feature
#: is worth looking at for is counted over all texts of the training part.
POSITIVES, UNLABELLED = 4_000, 16_000
#: Features are words and word beginnings of these lengths, seen in so many confirmed texts, and in
#: this share of them.
BEGINNINGS, SUPPORT, SHARE = (3, 4, 5, 6), 3, 0.01
#: Features whose log ratio of confirmed to all texts is no higher than this aren't looked at.
LEAST_RATIO = 0.5
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 0 by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def features(token: str) -> list[str]:
    """Of a token between white space: its words, as ``w`` and the word, and their beginnings, as a
    digit and these."""
    out = []
    for w in WORD.findall(token.lower()):
        out.append("w" + w)
        out += [f"{n}{w[:n]}" for n in BEGINNINGS if len(w) >= n]
    return out


class Reader:
    """Distinct features of whole texts, as numbers, by a bounded memory of tokens. Given a
    vocabulary, features outside it are passed over; else it grows one."""

    TOKENS = 300_000

    def __init__(self, vocabulary: dict[str, int] | None = None):
        self.grow = vocabulary is None
        self.vocabulary: dict[str, int] = {} if vocabulary is None else vocabulary
        self.known: dict[str, tuple[int, ...]] = {}
        kind = lambda k: {f[1:]: i for f, i in self.vocabulary.items() if f[0] == k}
        self.words, self.by = kind("w"), [(n, kind(str(n))) for n in BEGINNINGS]

    def _token(self, token: str) -> tuple[int, ...]:
        v = self.vocabulary
        if self.grow:
            got = tuple([v.setdefault(f, len(v)) for f in features(token)])
        else:
            # The same features as features() has, looked up by length without building their names.
            get, by, out = self.words.get, self.by, []
            for w in WORD.findall(token.lower()):
                out.append(get(w))
                n = len(w)
                for k, beginnings in by:
                    if n >= k:
                        out.append(beginnings.get(w[:k]))
            got = tuple([i for i in out if i is not None])
        if len(self.known) >= self.TOKENS:
            self.known.clear()
        if len(token) <= 64:
            self.known[token] = got
        return got

    def __call__(self, text: str) -> set[int]:
        known, out = self.known, set()
        for token in set(text.split()):
            got = known.get(token)
            if got is None:
                got = self._token(token)
            if got:
                out.update(got)
        return out


class NonNegativePU:
    """A linear score of sets of features, trained by the non-negative risk of positive and
    unlabelled sets.

    With class prior p and the logistic loss l, the risk is p E+[l(s)] + max(0, Eu[l(-s)] - p
    E+[l(-s)]): the part of the toxic texts among the unlabelled is taken off, and never below 0.
    The weights are the mean of the second half of the steps'.
    """

    def __init__(self, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 3e-4):
        self.prior, self.rounds, self.rate, self.decay = prior, rounds, rate, decay

    def risk(self, s: np.ndarray, n_pos: int) -> tuple[float, float]:
        """(risk of positives, risk of negatives before it is held at 0) of scores, positives first."""
        pos, unl = s[:n_pos], s[n_pos:]
        loss = lambda z: np.logaddexp(0, -z)
        return self.prior * loss(pos).mean(), loss(-unl).mean() - self.prior * loss(-pos).mean()

    def slope(self, s: np.ndarray, n_pos: int) -> np.ndarray:
        """Of the risk by each score. Where the risk of negatives is below 0 it has been overfitted:
        then it is stepped back along it instead."""
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        pos, unl = s[:n_pos], s[n_pos:]
        negative = np.concatenate([-self.prior * sig(pos) / n_pos, sig(unl) / len(unl)])
        if self.risk(s, n_pos)[1] < 0:
            return -negative
        negative[:n_pos] -= self.prior * sig(-pos) / n_pos
        return negative

    def fit(self, pos: list[np.ndarray], unl: list[np.ndarray], k: int) -> NonNegativePU:
        """Of sets of features from 0 to ``k``."""
        sets, n = [*pos, *unl], len(pos) + len(unl)
        row = np.repeat(np.arange(n), [len(s) for s in sets])
        col = np.concatenate([np.asarray(s, np.int64) for s in sets]) if len(row) else np.empty(0, np.int64)
        w, total = np.zeros(k + 1), np.zeros(k + 1)
        m, v = np.zeros(k + 1), np.zeros(k + 1)
        for step in range(1, self.rounds + 1):
            c = self.slope(w[k] + np.bincount(row, weights=w[col], minlength=n), len(pos))
            g = np.append(np.bincount(col, weights=c[row], minlength=k) + self.decay * w[:k], c.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            rate = self.rate * min(1.0, 2 * (1 - step / (self.rounds + 1)))
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if 2 * step > self.rounds:
                total += w
        total /= self.rounds - self.rounds // 2
        self.weights, self.bias = total[:k], float(total[k])
        return self


class ToxicModel:
    """Features and their weights; without a learner every text has the class prior."""

    def __init__(self, features_: list[str], pu: NonNegativePU | None, prior: float):
        self.vocabulary = {f: i for i, f in enumerate(features_)}
        self.weights = pu.weights if pu else None
        self.bias, self.prior = pu.bias if pu else 0.0, prior

    def scorer(self):
        """A function from a list of texts to their scores, with a memory of its own."""
        read = Reader(self.vocabulary)

        def do(texts: list[str]) -> np.ndarray:
            if self.weights is None or not texts:
                return np.full(len(texts), self.prior)
            s = np.array([self.weights[list(read(t))].sum() for t in texts]) + self.bias
            return 1 / (1 + np.exp(-np.clip(s, -50, 50)))

        return do

    def score(self, texts: list[str]) -> np.ndarray:
        return self.scorer()(texts)


def chosen(n_pos: np.ndarray, n_all: np.ndarray, positives: int, texts: int) -> np.ndarray:
    """Places of the features whose share among confirmed toxic texts stands out from that among all."""
    ratio = np.log((n_pos + 0.2) / (positives + 1)) - np.log((n_all + 2.0) / (texts + 10))
    return np.flatnonzero(ratio > LEAST_RATIO)


def train(positive: list[str], unlabelled: list[str], prior: float, support: int = SUPPORT) -> ToxicModel:
    """A model of the texts given, as ``fit`` makes one of tables."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return ToxicModel([], None, prior)
    read = Reader()
    n = np.bincount(np.array([i for t in positive for i in read(t)], np.int64), minlength=len(read.vocabulary))
    often = max(support, int(np.ceil(SHARE * len(positive))))
    found = sorted((f, n[i]) for f, i in read.vocabulary.items() if n[i] >= often)
    if not found:
        return ToxicModel([], None, prior)
    names = [f for f, _ in found]
    read = Reader({f: i for i, f in enumerate(names)})
    n_all = np.bincount(np.array([i for t in unlabelled for i in read(t)], np.int64), minlength=len(names))
    names = [names[i] for i in chosen(np.array([c for _, c in found]), n_all, len(positive), len(unlabelled))]
    read = Reader({f: i for i, f in enumerate(names)})
    sets = lambda texts: [np.fromiter(read(t), np.int64) for t in texts]
    return ToxicModel(names, NonNegativePU(prior).fit(sets(positive), sets(unlabelled), len(names)), prior)


def _features(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(f) the places of each text's features in the vocabulary."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the confirmed texts' features

    def make():
        read = Reader({f: i for i, f in enumerate(shared.value)})
        return lambda texts: [[list(read(t.decode("utf-8", "replace"))) for t in texts]]

    return map_text(df, "t", [T.StructField("f", T.ArrayType(T.LongType()))], make, [])


def _counts(df: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """How many of all texts have each feature, and how many texts there are. A task hands over one
    number a feature, which are added up by feature."""
    ship(df.sparkSession)
    shared, k = df.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def run(batches):
        read, total, n = Reader({f: i for i, f in enumerate(shared.value)}), np.zeros(k + 1, np.int64), 0
        for batch in batches:
            for start, size in slices(batch.column(0)):
                for t in batch.column(0).slice(start, size).to_pylist():
                    total[list(read(t.decode("utf-8", "replace")))] += 1
                    n += 1
        total[k] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["i", "n"])

    out = np.zeros(k + 1, np.int64)
    for r in df.select(F.col("t").cast("binary")).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out[:k], int(out[k])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicModel:
    """Train on rows that aren't held out; the class prior is the share of the toxic among all
    labelled rows of the training part.

    Candidates for features come from at most about ``positives`` confirmed toxic texts; how many
    texts have each is counted over all texts of the training part, whatever their labels; the
    learner's steps see the confirmed texts' sets of the chosen features, and those of about
    ``unlabelled`` texts. Either sample goes by the order of a hash of the id. No text comes to the
    driver. Null texts and ids don't train; without toxic labels the model knows the prior only."""
    d = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).filter(F.col("t").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    some = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    total, toxic = some.agg(F.count("*"), F.sum((F.col("y") == 1).cast("long"))).first()
    if not total or not toxic:
        return ToxicModel([], None, 0.0)
    h = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    share = lambda want, have: int(min(1.0, want / max(have, 1)) * (1 << 30))
    ids = some.filter((F.col("y") == 1) & (h < share(positives, toxic))).select("id").distinct()
    pos = d.join(F.broadcast(ids), "id").select("t")  # ``positives`` ids
    names = map_text(pos, "t", [T.StructField("f", T.ArrayType(T.StringType()))], _all_features, [])
    often = names.select(F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT)
    n_positive = pos.count()
    found = sorted((r["f"], r["n"]) for r in often.filter(F.col("n") >= max(SUPPORT, int(np.ceil(SHARE * n_positive)))).collect())
    if n_positive < 2 or not found:
        return ToxicModel([], None, toxic / total)
    vocabulary, n_pos = [f for f, _ in found], np.array([n for _, n in found])
    n_all, n_texts = _counts(d, vocabulary)
    vocabulary = [vocabulary[i] for i in chosen(n_pos, n_all, n_positive, n_texts)]
    unl = d.filter(h < share(unlabelled, n_texts)).select("t")
    sets = [[np.array(r["f"], np.int64) for r in _features(x, vocabulary).collect()] for x in (pos, unl)]
    if len(sets[1]) < 2:
        return ToxicModel([], None, toxic / total)
    return ToxicModel(vocabulary, NonNegativePU(toxic / total).fit(*sets, len(vocabulary)), toxic / total)


def _all_features():
    def do(texts: list[bytes]) -> list[list]:
        return [[sorted({f for token in set(t.decode("utf-8", "replace").split()) for f in features(token)}) for t in texts]]

    return do


def score(df: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score (double, 0 to 1) and predicted (int, 1 from 0.5 up) for every whole text. Null
    texts are scored as empty ones; repeated rows stay; no rows give no rows."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as the bounded sample's features

    def make():
        scored = shared.value.scorer()

        def do(texts: list[bytes | None]) -> list[list]:
            s = scored([(t or b"").decode("utf-8", "replace") for t in texts])
            return [s.tolist(), (s >= 0.5).astype(int).tolist()]

        return do

    return map_text(df, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, keep)
