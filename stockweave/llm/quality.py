"""Quality scores by positive-unlabelled learning.

A small network is fitted to trusted positives and unlabelled text by the
non-negative unbiased risk: positives weighted by the class prior, unlabelled
text as negatives less the prior's share of positives, kept from falling below
zero. The prior itself is estimated from the two samples. Negative labels are
never used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.llm.labelled import held_out, labelled_sample

# Rows of each kind that the fit may draw, at most.
SAMPLE = 6000
HIDDEN = 16
STEPS = 600

SYMBOLS = b"!%&$#*|.,;:?-_/<>{}[]()=+@~^\\\"'`"
KEPT = b"!%&$#*|<>{}="

UPPER, LOWER, DIGIT, BLANK, SYMBOL = (np.zeros(256, bool) for _ in range(5))
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = True
BLANK[[9, 10, 11, 12, 13, 32]] = True
SYMBOL[list(SYMBOLS)] = True


def features(text: bytes) -> list[float]:
    """Shares of bytes, words and lines of a text; all zero for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * N_FEATURES
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = counts[UPPER].sum() + counts[LOWER].sum() + 1
    words = text.split()
    lines = text.split(b"\n")
    n_words = len(words) or 1
    distinct = len(set(words))
    return [
        np.log1p(n) / 10,
        counts[UPPER].sum() / letters,
        counts[DIGIT].sum() / n,
        counts[SYMBOL].sum() / n,
        counts[BLANK].sum() / n,
        counts[128:].sum() / n,
        *[counts[b] / n_words for b in KEPT],
        np.log1p(n_words) / 10,
        sum(map(len, words)) / n_words / 10,
        # Of the words that the length leads to expect, how many are different.
        distinct / n_words,
        np.log1p(distinct) / np.log1p(n_words),
        np.log1p(len(lines)) / 10,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 10,
        max(map(len, words), default=0) / 100,
    ]


N_FEATURES = 14 + len(KEPT)


class Network:
    """One hidden layer; the output is the log odds of a positive."""

    def __init__(self, mean, scale, rng):
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.p = [
            rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN),
            rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1),
        ]

    def _hidden(self, x):
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.p[0] + self.p[1])

    def logit(self, x):
        return self._hidden(x) @ self.p[2] + self.p[3][0]

    def probability(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -35, 35)))

    def gradient(self, x, at_logit):
        """Gradient of a loss whose derivative by each row's logit is given."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = self._hidden(x)
        back = np.outer(at_logit, self.p[2]) * (1 - h**2)
        return [z.T @ back, back.sum(0), h.T @ at_logit, np.array([at_logit.sum()])]


def _descend(net: Network, gradient_of, steps: int, rate: float = 0.02, decay: float = 1e-4):
    """Adam with weight decay."""
    m, v = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for t in range(1, steps + 1):
        for k, g in enumerate(gradient_of(net)):
            g = g + decay * net.p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (
                np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8
            )


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> float:
    """Share of positives in the unlabelled text.

    A network tells the samples apart; above any score, the unlabelled share is
    at least the prior times the positive share, so the least ratio bounds the
    prior. Ratios are taken on halves not used for the fit, with an allowance for
    the noise of small counts.
    """
    rng = np.random.default_rng(seed)
    x = np.concatenate([positive, unlabelled])
    net = Network(x.mean(0), x.std(0) + 1e-6, rng)
    p0, p1, u0, u1 = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]
    if not (len(p1) and len(u1)):
        return 0.5

    def gradient(net):
        a = net.gradient(p0, (net.probability(p0) - 1) / len(p0))
        b = net.gradient(u0, net.probability(u0) / len(u0))
        return [x + y for x, y in zip(a, b, strict=True)]

    _descend(net, gradient, STEPS // 2)
    sp, su = np.sort(net.logit(p1)), np.sort(net.logit(u1))
    cuts = np.quantile(sp, np.linspace(0, 0.9, 91))
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    noise = (np.log(4 / 0.1) / 2) ** 0.5 * (len(sp) ** -0.5 + len(su) ** -0.5)
    best = np.argmin((above_u + noise) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = 0):
    """The network with the least non-negative risk, and the prior it was told.

    Without positives or unlabelled rows every text scores the prior, 0.5.
    """
    rng = np.random.default_rng(seed)
    if not len(positive) or not len(unlabelled):
        net = Network(np.zeros(N_FEATURES), np.ones(N_FEATURES), rng)
        net.p = [p * 0 for p in net.p]
        return net, 0.5
    if prior is None:
        prior = estimate_prior(positive, unlabelled, seed)
    net = Network(unlabelled.mean(0), unlabelled.std(0) + 1e-6, rng)

    def gradient(net):
        sp, su = net.probability(positive), net.probability(unlabelled)
        as_positive = net.gradient(positive, prior * (sp - 1) / len(sp))
        # Loss of a row as a negative is log(1 + e^f); its derivative is the score.
        risk = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(
            -np.minimum(sp, 1 - 1e-12)
        ).mean()
        sign = 1 if risk >= 0 else -1
        rest = [
            a - b
            for a, b in zip(
                net.gradient(unlabelled, su / len(su)),
                net.gradient(positive, prior * sp / len(sp)),
                strict=True,
            )
        ]
        if sign < 0:  # the negative part has fallen below zero: only undo that
            return [-r for r in rest]
        return [a + r for a, r in zip(as_positive, rest, strict=True)]

    _descend(net, gradient, STEPS)
    return net, prior


def fit_on(df: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, **cols):
    """Fit on at most ``sample`` positives and ``sample`` unlabelled training rows."""
    rows = labelled_sample(df, labels, label, {1: sample}, n_any=sample, **cols)

    def run(batches):
        for b in batches:
            x = [features((t or "").encode()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["kind", "x"]
            )

    got = rows.mapInArrow(run, "kind int, x array<double>").toPandas()
    # The rows come in any order; the fit must not depend on it.
    x = np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES)
    kind = got["kind"].to_numpy(int)
    order = np.lexsort([*x.T, kind])
    x, kind = x[order], kind[order]
    mix = np.random.default_rng(1).permutation(len(x))
    x, kind = x[mix], kind[mix]
    return fit(x[kind == 1], x[kind == -1])


def score_quality(
    df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **how
) -> DataFrame:
    """``df`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.5).

    Texts are scored by their own bytes only. A null or empty text gets the score
    of an empty text; with no label at all every score is 0.5. Repeated rows get
    equal scores; a null id counts as an empty text for ``held_out``. Columns of
    the new names are replaced, others stay. An empty table gives an empty table.
    """
    net, _ = fit_on(df, labels, text=text, doc_id=doc_id, **how)
    return scored(df, lambda texts: net.probability(np.array([features(t) for t in texts])),
                  0.5, text, doc_id)


def scored(df: DataFrame, score_of, cut: float, text: str, doc_id: str) -> DataFrame:
    """``df`` with held_out, score and predicted; ``score_of`` takes a list of texts."""
    new = ("held_out", "score", "predicted")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new])
    place = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).cast(pa.binary()).to_pylist()
            out = []
            for k in range(0, len(texts), 1000):
                out.append(score_of([t or b"" for t in texts[k : k + 1000]]))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64())],
                names=[*batch.schema.names, "score"],
            )

    return df.mapInArrow(run, schema).select(
        *[F.col(f"`{c}`") for c in df.columns],
        held_out(F.col(f"`{doc_id}`")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
