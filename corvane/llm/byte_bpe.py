"""Byte-level BPE encoding and decoding with numpy.

Distinct pre-tokens of a slice of documents are laid out as padded matrices, one per length bucket. In every round each
row merges its leftmost pair of minimum rank; ranks of pairs come from an open-addressing hash table that is probed for
whole columns at once. Finished rows leave the matrix and merged rows close up, so matrices shrink in both directions.

Results equal ``tiktoken.Encoding(...).encode_ordinary`` for the same ranks and pattern: special-token strings in a text
are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import held, with_arrow

#: Upper bounds in bytes of the length buckets; pre-tokens beyond the last are merged one by one with a heap.
BUCKETS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512)
#: Rows of a matrix at most, so that its memory is bounded.
MATRIX_CELLS = 1 << 18
#: Entries that a worker's cache of encoded units holds at most; beyond that, those of the texts at hand stay.
CACHE_UNITS = 250_000

_NONE = np.int32(np.iinfo(np.int32).max)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: A boundary that the usual byte-level patterns always respect: one space between two characters that are no space.
_SPACES = re.compile(r"\s(?:\s|\Z)")
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def units(text: str) -> list[str]:
    """``text`` cut before every single space that stands between two non-space characters; the parts join to ``text``.

    Byte-level patterns whose tokens begin with at most one optional space never match across such a place, so each unit
    can be split on its own.
    """
    if not text:
        return []
    if text[0].isspace() or "\0" in text or _SPACES.search(text):
        return _SAFE.split(text)
    return text.replace(" ", "\0 ").split("\0")


def pre_tokens(unit: str, findall) -> list[str]:
    """The matches of a byte-level pattern in one unit; words, bare or with one mark behind, need no regular expression."""
    if (word := unit[1:] if unit[0] == " " else unit).isalpha():
        return [unit]
    if word[-1:] in (",", ".") and word[:-1].isalpha():
        return [unit[:-1], unit[-1]]
    return findall(unit)


def cached(cut: list[list[str]], cache: dict[str, bytes], learn: Callable[[set[str]], None], limit: int = CACHE_UNITS) -> list[bytes]:
    """The ids of each text, joined from those of its units. ``learn`` adds the units that ``cache`` lacks; should they overfill
    it, it loses all units but those of the texts at hand."""
    found = [[*map(cache.get, us)] for us in cut]
    missing = {u for us, ids in zip(cut, found, strict=True) for u, x in zip(us, ids, strict=True) if x is None}
    if len(cache) + len(missing) > limit:
        cache.clear()
        cache.update((u, x) for us, ids in zip(cut, found, strict=True) for u, x in zip(us, ids, strict=True) if x is not None)
    if missing:
        learn(missing)
    return [b"".join([cache[u] if x is None else x for u, x in zip(us, ids, strict=True)]) for us, ids in zip(cut, found, strict=True)]


class PairTable:
    """Hash table from pairs of token ids to the id of their merger, probed for arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        bits = max(4, int(2 * len(keys) - 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = self._slot(keys[todo], step)
            free = self.keys[at] == _EMPTY
            _, first = np.unique(at, return_index=True)
            chosen = np.zeros(len(todo), bool)
            chosen[first] = True
            won = free & chosen
            self.keys[at[won]], self.values[at[won]] = keys[todo[won]], merged[todo[won]]
            # A row that lost a free slot to another tries the next one: linear probing leaves no gap before it.
            todo, step = todo[~won], step + 1
        self.reach = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys * _MIX >> self.shift).astype(np.int64) + step) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the mergers, elementwise; the largest int32 where a pair does not merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        flat = keys.ravel()
        out = np.full(flat.shape, _NONE, np.int32)
        todo = np.arange(len(flat))
        for step in range(self.reach):
            at = self._slot(flat[todo], step)
            seen = self.keys[at]
            hit = seen == flat[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (seen != _EMPTY)]
            if not len(todo):
                break
        return out.reshape(keys.shape)


@lru_cache(maxsize=1)
def pieces(ranks_path: str) -> list[bytes]:
    """Bytes of each id of a file of ``base64 rank`` lines; an id that the file leaves out stands for none."""
    with open(ranks_path, "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def decode_packed(packed: bytes | None, table: list[bytes]) -> bytes:
    """Bytes of packed ids; null counts as no ids. An id outside the vocabulary raises IndexError."""
    return b"".join(map(table.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))


class BytePairCodec:
    """Encoder for a file of ``base64 rank`` lines and a pre-token pattern (syntax of the regex library).

    ``split_units``: the pattern takes letters with one optional space before them as a token and never matches across the
    boundaries of ``units()``, which lets repeated words be encoded once; set it to False for a pattern that differs.
    """

    def __init__(self, ranks_path: str, pattern: str, split_units: bool = True) -> None:
        import regex

        self.pieces = pieces(ranks_path)
        self.ranks = {piece: rank for rank, piece in enumerate(self.pieces) if piece}
        self.pattern = regex.compile(pattern)
        self.split_units = split_units
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(np.array(left), np.array(right), np.array(merged, np.int32))
        self.cache: dict[str, bytes] = {}

    # -- merging -----------------------------------------------------------------------------------------------------

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for high in BUCKETS:
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            step = max(1, MATRIX_CELLS // high)
            for i in range(0, len(rows), step):
                self._matrix(words, rows[i : i + step], high, sizes, out)
            low = high
        for i in np.flatnonzero(sizes > BUCKETS[-1]):
            out[i] = self.merge_word(words[i])
        return out

    def _matrix(self, words: list[bytes], rows: np.ndarray, width: int, sizes: np.ndarray, out: list[bytes]) -> None:
        size = sizes[rows]
        padded = b"".join(words[i].ljust(width, b"\0") for i in rows)
        ids = self.byte_ids[np.frombuffer(padded, np.uint8).reshape(len(rows), width)]
        columns = np.arange(width)
        ranks = np.full((len(rows), width), _NONE, np.int32)  # of the pair that begins in each column
        if width > 1:
            ranks[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
            ranks[columns[None, :] >= size[:, None] - 1] = _NONE
        while len(rows):
            at = ranks.argmin(1)  # the first of equal minima: the leftmost pair
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = ids[k, : size[k]].astype("<u4").tobytes()
                live = ~done
                rows, size, at, best = rows[live], size[live], at[live], best[live]
                if not len(rows):
                    return
                keep = int(size.max())
                ids, ranks = ids[live, :keep], ranks[live, :keep]
            here, width = np.arange(len(rows)), ids.shape[1]
            take = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
            np.minimum(take, width - 1, out=take)
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ids[here, at] = best
            size = size - 1
            ranks[here, size - 1] = _NONE  # the last token of a row begins no pair
            ranks[:, -1] = _NONE
            for begin, ok in ((at, at < size - 1), (at - 1, at > 0)):
                k = np.flatnonzero(ok)
                ranks[k, begin[k]] = self.pairs.find(ids[k, begin[k]], ids[k, begin[k] + 1])

    def merge_word(self, word: bytes) -> bytes:
        """The same merges, in the same order, for one word of any length: pairs wait in a heap by rank and place."""
        n = len(word)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        ranks, pieces = self.ranks, self.pieces
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := ranks.get(pieces[ids[i]] + pieces[ids[j]])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], "<u4").tobytes()

    # -- texts -------------------------------------------------------------------------------------------------------

    def _learn(self, missing: Iterable[str]) -> None:
        """Encodes units into the cache, each match of the pattern separately."""
        missing = list(missing)
        findall = self.pattern.findall
        parts = [pre_tokens(u, findall) for u in missing] if self.split_units else [findall(u) for u in missing]
        distinct = list({p for ps in parts for p in ps})
        coded = dict(zip(distinct, self.merge_rows([p.encode() for p in distinct]), strict=True))
        self.cache.update(zip(missing, (b"".join(map(coded.__getitem__, ps)) for ps in parts), strict=True))

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text counts as empty."""
        split = units if self.split_units else (lambda t: [t] if t else [])
        cut = [split(t or "") for t in texts]
        return cached(cut, self.cache, self._learn)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()


def codec(ranks_path: str, pattern: str, split_units: bool = True) -> BytePairCodec:
    """The codec that a worker process keeps, with its tables and cache."""
    return held(("codec", ranks_path, pattern, split_units), lambda: BytePairCodec(ranks_path, pattern, split_units))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", packed: bool = False, keep: list[str] | None = None, split_units: bool = True) -> DataFrame:
    """``docs`` with ``ids``: the token ids of each whole text, as array<int> or, ``packed``, as little-endian u32 bytes.

    Null and empty texts have no ids (an empty value, never null). Rows keep their number and columns: repeated rows are
    encoded each, an input column named like ``ids`` is replaced, an empty table stays empty. No shuffle.
    """

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        got = codec(ranks_path, pattern, split_units).encode_packed(part.column(text).to_pylist())
        if packed:
            return {ids: pa.array(got, pa.binary())}
        ends = np.cumsum([0, *[len(x) // 4 for x in got]])
        values = pa.array(np.frombuffer(b"".join(got), "<i4"))
        return {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)}

    return with_arrow(docs, kernel, f"`{ids}` {'binary' if packed else 'array<int>'}", text, keep)


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: the bytes that packed ``ids`` stand for. Null counts as no ids and decodes to no bytes; rows and
    other columns stay, an input column named ``out`` gives way. No shuffle."""

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        table = pieces(ranks_path)
        return {out: pa.array([decode_packed(x, table) for x in part.column(ids).to_pylist()], pa.binary())}

    return with_arrow(df, kernel, f"`{out}` binary", ids, keep)
