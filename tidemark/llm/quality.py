"""Document quality by hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_groups, map_text

#: Bound of the labelled rows that the document classifier is fitted on.
LABELLED = 6_000
#: Paths whose posteriors are sent to all rows; more are joined.
MOST_SENT = 100_000
#: Classes of characters, as bytes.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"?", b".", b",", b"|", b"*", b"#", b"$", b"%", b"&", b"@+=<>{}[]()/\\~^_`", b"\n", b" ", b"'\"-:;",
)


def describe(text: bytes) -> np.ndarray:
    """Numbers that tell prose from junk: shares of characters, of different words and lines, and
    lengths. An empty text has zeros."""
    n = len(text)
    out = np.zeros(len(CLASSES) + 8)
    if not n:
        return out
    for i, chars in enumerate(CLASSES):
        out[i] = text.count(chars) / n if len(chars) == 1 else (n - len(text.translate(None, chars))) / n
    words = text.split()
    lines = text.split(b"\n")
    k = len(CLASSES)
    m = max(len(words), 1)
    out[k] = len(set(words)) / m
    out[k + 1] = np.log1p(len(words))
    out[k + 2] = np.log1p(n / m)
    out[k + 3] = len(set(lines)) / len(lines)
    out[k + 4] = np.log1p(len(lines))
    out[k + 5] = np.log1p(max(map(len, words), default=0))
    out[k + 6] = len(set(words)) / m**0.7
    out[k + 7] = 1.0 if m < 5 else 0.0
    return np.concatenate([np.sqrt(out[: len(CLASSES)]), out[len(CLASSES) :]])


class Logistic:
    """Ridge logistic regression by Newton's steps, in numpy."""

    def __init__(self, w: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float):
        self.w, self.mean, self.scale, self.prior = w, mean, scale, prior

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        prior = (y.sum() + 1) / (len(y) + 2)
        w = np.zeros(z.shape[1])
        w[0] = np.log(prior / (1 - prior))
        penalty = np.r_[1e-9, np.full(x.shape[1], ridge)]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return cls(w, mean, scale, prior)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of good to bad: the log-odds less those of the prior."""
        logit = np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.w
        return np.clip(logit - np.log(self.prior / (1 - self.prior)), -30, 30)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED) -> Logistic | None:
    """The document classifier, from at most about ``labelled`` labelled rows by the order of a hash
    of the id, whose ids are sent to the documents; None if one of the two labels is missing."""
    some = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    n = some.count()
    if not n:
        return None
    share = int(min(1.0, labelled / n) * (1 << 30))
    picked = some.filter(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30)) < share)
    d = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    rows = described(d.join(F.broadcast(picked), "id").select("t", "y"), "t", ["y"]).toPandas()  # ``labelled`` ids
    if rows["y"].nunique() < 2:
        return None
    return Logistic.fit(np.stack(rows["described"].to_numpy()), rows["y"].to_numpy(float))


def described(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    field = T.StructField("described", T.ArrayType(T.DoubleType()))
    return map_text(df, text, [field], lambda: lambda texts: [[describe(t or b"") for t in texts]], keep)


def evidence(df: DataFrame, model: Logistic | None, text: str, keep: list[str]) -> DataFrame:
    """Add evidence (double) of the text alone; without a model it is 0."""

    def make():
        def do(texts: list[bytes | None]) -> list[list]:
            if model is None or not texts:
                return [[0.0] * len(texts)]
            return [model.evidence(np.stack([describe(t or b"") for t in texts])).tolist()]

        return do

    return map_text(df, text, [T.StructField("evidence", T.DoubleType())], make, keep)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def shrunk(groups: DataFrame, parent: Column) -> Column:
    """Posterior mean of a group's share of good documents: ``good`` of ``n`` shrunk toward
    ``parent`` with the strength (column ``strength``) of pseudo-documents."""
    return (F.col("good") + F.col("strength") * parent) / (F.col("n") + F.col("strength"))


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", accept: float = 0.5
) -> DataFrame:
    """``docs`` with evidence, host_quality, path_quality and quality_prob (double) and accepted
    (boolean), which replace columns of those names.

    The classifier's evidence on every document is summed by host and by path in host (here the
    language) over all rows. The spread of the hosts' shares of good documents, less what their
    numbers of documents explain, gives the strength with which a host is shrunk toward the global
    share; likewise paths toward their host. A document's probability joins its own evidence with
    its path's posterior, its own part taken out; it is accepted from ``accept`` up.

    Null texts count as empty; null hosts and paths are groups of their own; without labels of both
    kinds the evidence is 0 and all are accepted; repeated rows stay; no rows give no rows.
    """
    names = ["evidence", "host_quality", "path_quality", "quality_prob", "accepted"]
    keys = ["__host", "__path"]
    model = fit(docs, labels, doc_id, text)
    prior = model.prior if model else 1.0
    p = _sigmoid(F.col("evidence") + float(np.log(prior / (1 - prior))) if model else F.lit(30.0))
    # Evidence is worked out twice, for the groups and for the rows: that costs less than to shuffle
    # or write all texts.
    own = evidence(docs.select(*_keys(host, path), F.col(f"`{text}`").alias("__t")), model, "__t", keys)
    paths = cut(own.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(p).alias("good")), "paths")
    hosts = cut(paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    world = float(total[1] / total[0]) if total[0] else prior

    def strength(groups: DataFrame, expected: Column) -> float:
        """Of a beta prior about ``expected``, by the moments of the groups' shares."""
        share, weight = F.col("good") / F.col("n"), F.col("n")
        spread = F.col("n") * (share - expected) * (share - expected)
        row = groups.agg(F.sum(weight), F.sum(spread), F.sum(expected * (1 - expected) * weight), F.count("*")).first()
        n, got, pq, k = (float(v or 0) for v in row)
        if n <= k or pq <= 0:
            return 100.0
        pq, var = pq / n, got / n
        extra = max((var - pq * k / n) / (1 - k / n), 1e-4 * pq)
        return float(min(max(pq / extra - 1, 1.0), 1e4))

    hosts = hosts.withColumn("strength", F.lit(strength(hosts, F.lit(world))))
    hosts = hosts.select("__host", shrunk(hosts, F.lit(world)).alias("host_quality"))
    paths = paths.join(hosts, "__host")
    paths = paths.withColumn("strength", F.lit(strength(paths, F.col("host_quality"))))
    posterior = [F.col(c).alias(f"__{c}") for c in ("n", "good", "strength", "host_quality")]
    paths = cut(paths.select(*keys, *posterior, shrunk(paths, F.col("host_quality")).alias("__path_quality")), "posteriors")
    # By number, so that no name of the input can clash with one of the work.
    kept = [c for c in docs.columns if c.lower() not in names]
    own_columns = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(own_columns, kept, strict=True)), *_keys(host, path), F.col(f"`{text}`").alias("__t"))
    scored = evidence(rows, model, "__t", [*own_columns, *keys])
    if paths.count() <= MOST_SENT:
        joined = scored.join(F.broadcast(paths), keys)  # MOST_SENT rows of a few numbers
    else:
        joined = join_groups(scored, paths, keys, ["evidence"], "__n", int(total[0]))
    # A document's own part is taken out of its path, so that it doesn't count twice.
    rest = F.greatest((F.col("__good") - p + F.col("__strength") * F.col("__host_quality")) / (F.col("__n") - 1 + F.col("__strength")), F.lit(1e-6))
    prob = _sigmoid(F.col("evidence") + _logit(rest)) if model else F.lit(1.0)
    out = joined.withColumn("quality_prob", prob)
    back = [F.col(n).alias(c) for n, c in zip(own_columns, kept, strict=True)]
    return out.select(*back, "evidence", F.col("__host_quality").alias("host_quality"), F.col("__path_quality").alias("path_quality"), "quality_prob", (F.col("quality_prob") >= accept).alias("accepted"))


def _keys(host: str, path: str) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")).alias(n) for c, n in ((host, "__host"), (path, "__path"))]
