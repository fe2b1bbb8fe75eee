"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and towards its own average variance. Both
come from sums that Spark adds up over all labelled rows, so nothing but a few matrices reaches the driver. A score is
the logistic of the difference of log densities (Mahalanobis distances and log determinants from Cholesky factors that
are computed once) and the log ratio of the priors.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import with_arrow

#: Names of the statistics, in the order of the feature vector.
STATISTICS = (
    "log_words", "log_word_length", "spread_word_length", "upper_share", "digit_share", "bar_share", "bang_share", "mark_share",
    "stop_share", "wide_share", "newline_share", "distinct_words", "top_word_share", "repeated_next_share", "capital_words", "repeated_line_share", "marked_word_share",
)
#: Shares move by this before the logarithm, so that a share of nothing stays finite.
FLOOR = 1e-3
#: Statistics are held within this many pooled standard deviations of the pooled mean: one odd text can't outvote the rest.
BOUND = 8.0


def _masks() -> np.ndarray:
    masks = np.zeros((256, 8))
    for k, signs in enumerate((range(65, 91), range(48, 58), b"|", b"!", b"*#$%&@^~<>=_\\{}[]+", b".,;:?", range(128, 256), b"\n")):
        masks[list(signs), k] = 1
    return masks


def statistics(texts: list[str | None]) -> np.ndarray:
    """The transformed statistics of each text, a row each; null counts as empty, and an empty text has floor values."""
    masks = _masks()
    hist = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), len(STATISTICS) - 8))
    for i, text in enumerate(texts):
        if not text:
            continue
        hist[i] = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        words = text.split()
        n = len(words)
        if not n:
            continue
        sizes = np.fromiter(map(len, words), np.int32, n)
        count = Counter(words)
        lines = text.split("\n")
        mean = sizes.mean()
        rest[i] = (
            np.log1p(n), np.log(mean), np.log1p(sizes.std()), len(count) / n**0.9, np.log(max(count.values()) / n + FLOOR),
            np.log(sum(map(str.__eq__, words[1:], words[:-1])) / n + FLOOR), np.log(sum(map(str.isupper, words)) / n + FLOOR), np.log((len(lines) - len(set(lines))) / len(lines) + FLOOR),
            np.log(1 - sum(map(str.isalpha, words)) / n + FLOOR),
        )
    length = np.maximum(hist.sum(1, keepdims=True), 1)
    shares = np.log(hist @ masks / length + FLOOR)
    return np.concatenate([rest[:, :3], shares, rest[:, 3:]], axis=1)


def featurise(docs: DataFrame, text: str = "text", out: str = "features", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``, the statistics of each whole text as array<double>. No shuffle; null texts count as empty."""

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        x = statistics(part.column(text).to_pylist())
        ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
        return {out: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))}

    return with_arrow(docs, kernel, f"`{out}` array<double>", text, keep)


@dataclass
class Discriminant:
    """Two fitted classes; ``factors`` are the lower Cholesky factors of their shrunk covariances, inverted."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    log_prior: float
    sharpness: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        z = np.clip((x - self.centre) / self.scale, -BOUND, BOUND)
        logs = [-0.5 * (np.square((z - m) @ f.T).sum(1) + d) for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.sharpness * (logs[1] - logs[0]) + self.log_prior, -500, 500)))


def fit_moments(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, pool: float = 0.3, sphere: float = 0.02, sharpness: float = 0.5) -> Discriminant:
    """The discriminant for class counts (2), sums (2 x d) and sums of outer products (2 x d x d).

    ``pool`` is each class covariance's share of the pooled one, ``sphere`` its share of a multiple of the identity;
    ``sharpness`` scales the log density difference, as statistics that depend on each other overstate it. A class
    without rows takes the pooled mean and covariance, and priors are counts plus one.
    """
    n = np.asarray(n, float)
    d = sums.shape[1]
    total = max(n.sum(), 1.0)
    centre = sums.sum(0) / total
    spread = squares.sum(0) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-6))
    pooled, covs, means = np.zeros((d, d)), [], []
    for k in (0, 1):
        mean = sums[k] / n[k] if n[k] else centre
        cov = squares[k] / n[k] - np.outer(mean, mean) if n[k] else spread
        means.append((mean - centre) / scale)
        covs.append(cov / np.outer(scale, scale))
        pooled += covs[-1] * n[k] / total
    factors, logdets = [], []
    for cov in covs:
        mixed = (1 - pool) * cov + pool * pooled
        mixed = (1 - sphere) * mixed + sphere * max(np.trace(mixed) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(mixed + 1e-9 * np.eye(d))
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(factors), np.array(logdets), float(np.log((n[1] + 1) / (n[0] + 1))), sharpness)


def fit(labelled: DataFrame, features: str = "features", label: str = "label", **shrinkage: float) -> Discriminant:
    """Fits to all rows of ``labelled`` whose label is 0 or 1; rows with another or no label don't count.

    Each task sums its rows before the shuffle; the driver gets 2 x (1 + d + d * d) numbers, whatever the rows' number.
    """
    d = len(STATISTICS)

    def moments(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            y = np.array(batch.column("y").to_pylist())
            x = np.array(batch.column("x").to_pylist(), float).reshape(len(y), d)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(0)
                q[k] += own.T @ own
        flat = np.concatenate([n, s.ravel(), q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "v"])

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), F.col(features).alias("x"))
    got = rows.mapInArrow(moments, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for r in got:
        flat[r["cell"]] = r["v"]
    return fit_moments(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d), **shrinkage)


def score(df: DataFrame, model: Discriminant, features: str = "features", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``, the probability of label 1 for each feature vector; a null vector counts as that of an empty text.
    Rows that repeat have equal scores, an empty table stays empty, an input column named ``out`` gives way. No shuffle."""
    empty = statistics([None])[0]

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack([empty if v is None else v for v in x])) if len(x) else np.zeros(0))

    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    return df.select(*[F.col(f"`{c}`") for c in kept], scored(F.col(features)).alias(out))
