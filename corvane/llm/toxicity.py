"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. A window of a text is compressed with
each; where the toxic dictionary makes it shorter, its content resembles what toxic text has and ordinary text has not.
Windows are single words, lower-cased and framed three times over, as zstandard stores shorter inputs as they are. What
a gain of so many bytes on a window of such a length says is calibrated on labelled documents that the dictionaries have
not seen, and so is the logistic rule that turns the weights and gains of a document's windows into a probability.

Toxic documents are mostly ordinary words, so the toxic dictionary is trained on those windows of theirs that ordinary
documents lack (``contrast`` in ``train``): else both dictionaries would learn the same words.
"""

from __future__ import annotations

import warnings
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import held, with_arrow

#: zstandard level: the optimal parser, whose lengths differ by content rather than by chance.
LEVEL = 19
#: Bytes of the dictionaries, ordinary and toxic.
ORDINARY_BYTES, TOXIC_BYTES = 16384, 4096
#: Characters of a window; a longer word makes several.
WINDOW_CHARS = 64
#: Labelled rows at most that the classifier is fitted on, toxic and ordinary, and bytes of their texts: rows come in order
#: of the hash of their doc_id, and one whose text would pass the bound in bytes is not among them.
FIT_TOXIC, FIT_ORDINARY, FIT_BYTES = 2000, 3000, 32 << 20
#: A telling word occurs in this share of the toxic documents of the fit, and in two.
LEAST_SHARE = 0.004
#: Entries that a worker's cache of window gains holds at most.
CACHE = 250_000


def windows(text: str | None) -> list[str]:
    """The windows of a whole text, in order; none for null, empty and blank texts."""
    words = (text or "").lower().split()
    if any(len(w) > WINDOW_CHARS for w in words):
        words = [w[i : i + WINDOW_CHARS] for w in words for i in range(0, len(w), WINDOW_CHARS)]
    return words


def frame(window: str) -> bytes:
    b = window.encode()
    return b" " + b + b" " + b + b" " + b + b" "


#: Cells of the calibration: window bytes up to 15, gains from -4 to 8.
LENGTHS, LOW, HIGH = 16, -4, 8
CELLS = LENGTHS * (HIGH - LOW + 1)


class Gains:
    """Cell of each window: its length, and the bytes that the toxic dictionary saves against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = self._compressor(ordinary), self._compressor(toxic)
        self.known: dict[str, int] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        known = self.known
        needed = set().union(*texts)
        missing = needed.difference(known)
        if len(known) + len(missing) > CACHE:  # the windows of these texts stay
            kept = {w: known[w] for w in needed - missing}
            known.clear()
            known.update(kept)
        ordinary, toxic = self.ordinary.compress, self.toxic.compress
        for w in missing:
            f = frame(w)
            gain = len(ordinary(f)) - len(toxic(f))
            known[w] = min((len(f) - 4) // 3, LENGTHS - 1) * (HIGH - LOW + 1) + min(max(gain, LOW), HIGH) - LOW
        return [np.fromiter(map(known.__getitem__, ws), np.int16, len(ws)) for ws in texts]


def gains(ordinary: bytes, toxic: bytes) -> Gains:
    """The compressors that a worker process keeps, with their cache."""
    return held(("gains", ordinary, toxic), lambda: Gains(ordinary, toxic))


def signals(cells: np.ndarray, weights: np.ndarray) -> list[float]:
    """What the rule sees of a document: sum, maximum and counts of its windows' weights, how many gain so many bytes, both
    also by density, and the number of windows."""
    if not len(cells):
        cells = np.zeros(1, np.int64)  # the least gain of an empty window: it weighs nothing
        n = 0
    else:
        n = len(cells)
    weight, gain = weights[cells], cells % (HIGH - LOW + 1) + LOW
    heavy = [np.count_nonzero(weight >= k) for k in (0.5, 1, 2, 3)]
    gained = [np.count_nonzero(gain >= k) for k in (2, 3, 4, 5)]
    return [np.log1p(weight.sum()), weight.max(), *np.log1p(heavy), *np.log1p(gained), *np.sqrt(np.array(gained[:3]) / max(n, 1)), *np.sqrt(np.array(heavy) / max(n, 1)), np.log1p(n)]


@dataclass
class Classifier:
    """Dictionaries and the calibrated rule; ``ordinary`` is empty where labelled rows lacked a class."""

    ordinary: bytes
    toxic: bytes
    cells: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.ordinary:
            return np.zeros(len(texts))
        x = np.array([signals(g, self.cells) for g in gains(self.ordinary, self.toxic).of([windows(t) for t in texts])]).reshape(len(texts), -1)
        z = np.column_stack([(x - self.centre) / self.scale, np.ones(len(x))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _dictionary(size: int, frames: list[bytes]) -> bytes:
    """A trained dictionary; where the trainer finds too little, the frames themselves serve as content."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, frames)) // 2)), frames, k=40, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(frames)[-size:].rjust(16, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str | None], labels: list[int], contrast: float = 20.0, seed: int = 7) -> Classifier:
    """Dictionaries from one half of the rows, the rule from the other, so that it sees unread documents' gains.

    ``contrast``: a toxic window's share of toxic documents must be that many times its number among ordinary ones. Texts
    that repeat count once, as toxic if any of their rows is.
    """
    known: dict[str | None, int] = {}
    for t, y in zip(texts, labels, strict=True):
        known[t] = max(y, known.get(t, 0))
    rows = [*known.items()]
    random.Random(seed).shuffle(rows)
    halves = [[r for k in (0, 1) for r in [x for x in rows if x[1] == k][h::2]] for h in (0, 1)]
    if not all(any(y == k for _, y in half) for half in halves for k in (0, 1)):
        return Classifier(b"", b"", np.zeros(0), np.zeros(0), np.ones(0), np.zeros(0))
    # Windows are made anew in each pass: the driver holds the texts and counts of words of toxic documents, nothing more.
    toxic_texts, ordinary_texts = [[t for t, y in halves[0] if y == k] for k in (1, 0)]
    seen = Counter(w for t in toxic_texts for w in set(windows(t)))
    least = max(2, LEAST_SHARE * len(toxic_texts))
    often = {w: n for w, n in seen.items() if n >= least}
    among = Counter(w for t in ordinary_texts for w in set(windows(t)) if w in often)
    telling = {w for w, n in often.items() if n > contrast * among[w]}
    # A window counts once a document: what matters is in how many documents a dictionary's content occurs.
    ordinary = [w for t in ordinary_texts for w in dict.fromkeys(windows(t))]
    toxic = [w for t in toxic_texts for w in windows(t) if w in telling] or [w for t in toxic_texts for w in windows(t)]
    made = [_dictionary(size, [frame(w) for w in ws] or [b" " * 16]) for size, ws in ((ORDINARY_BYTES, ordinary), (TOXIC_BYTES, toxic))]
    gains_ = Gains(*made)
    got = [gains_.of([windows(t)])[0] for t, _ in halves[1]]
    labels = np.array([y for _, y in halves[1]])
    # Weight of a cell: log ratio of the shares of toxic and ordinary documents that have such a window; none below zero.
    having = np.array([np.bincount(g, minlength=CELLS) > 0 for g in got])
    shares = [(having[labels == k].sum(0) + 0.5) / ((labels == k).sum() + 1) for k in (0, 1)]
    cells = np.maximum(np.log(shares[1] / shares[0]), 0)
    x = np.array([signals(g, cells) for g in got])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    weights = _logistic(np.column_stack([(x - centre) / scale, np.ones(len(x))]), labels.astype(float))
    return Classifier(*made, cells, centre, scale, weights)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_toxic: int = FIT_TOXIC, most_ordinary: int = FIT_ORDINARY, most_bytes: int = FIT_BYTES) -> Classifier:
    """Fits to a bounded sample of ``labels`` (doc_id, ``label``): at most ``most_toxic`` rows of label 1 and
    ``most_ordinary`` of label 0, those of the lowest hash of doc_id, with their whole texts, and at most ``most_bytes``
    bytes of text (UTF-8) for each label.

    Other and null labels don't count; a doc_id with both is toxic. Without rows of either class the classifier scores every
    text 0.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = [r for k, most in ((1, most_toxic), (0, most_ordinary)) for r in known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    picked = spark.createDataFrame([(r["doc_id"], r["y"]) for r in chosen], "doc_id long, y int")
    # The sample has a fixed bound, so this side may be broadcast and what it finds may be ranked in one task a label.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text").dropDuplicates()
    fitting = found.where(F.octet_length("text") <= most_bytes)  # a longer text goes alone, not with all behind it
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    rows = fitting.withColumn("upto", size).where(F.col("upto") <= most_bytes).select("doc_id", "y", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    if chosen and len({r["y"] for r in rows}) < len({r["y"] for r in chosen}):
        warnings.warn(f"no text of a labelled class is there, or has {most_bytes} bytes or fewer: every score is 0", stacklevel=2)
    return train([r["text"] for r in rows], [r["y"] for r in rows])


def score(docs: DataFrame, model: Classifier, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``, the probability that each whole text is toxic. Null, empty and blank texts have no window and
    get the rule's score for none; rows and other columns stay, an input column named ``out`` gives way. No shuffle."""

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {out: pa.array(model.scores(part.column(text).to_pylist()), pa.float64())}

    return with_arrow(docs, kernel, f"`{out}` double", text, keep)
