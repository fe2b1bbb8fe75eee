"""Token counts that follow edits.

A document's pre-tokens lie in blocks of ``BLOCK``; a segment tree over the blocks sums their characters and tokens. An
edit finds its blocks by descent, takes up the pre-tokens that it touches and the context by which it can change
boundaries, encodes that region anew until a boundary of the old text returns, and updates the sums on the paths above
the blocks it touched. Nothing else of the document is encoded again.

Trees are columns (``TREE``) beside the text: a later batch of edits takes them up from a table, cuts pre-tokens from the text
only in the blocks that it touches, and gives back the text and the tree as they then are.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.byte_bpe import BytePairCodec
from corvane.llm.common import held, with_arrow

#: Pre-tokens of a fresh block.
BLOCK = 32
#: A pre-token stands if it ends this many characters before an edit: no alternative of the pattern looks farther ahead.
CONTEXT = 3
#: Entries that a worker's cache of pre-token counts holds at most.
CACHE = 250_000

#: Fewer pre-tokens than this, as one edit brings, are encoded one by one instead of in matrices.
FEW = 200

EDIT = "array<struct<start:int,stop:int,replacement:string>>"

#: Columns of a tree: characters and tokens of each pre-token, pre-tokens of each block, and the sums of the binary tree over
#: the blocks (node i above nodes 2i and 2i + 1, the root at 1, the blocks from half of the length on).
TREE = ("piece_chars", "piece_tokens", "block_pieces", "node_chars", "node_tokens")


class Counter:
    """Counts of tokens by pre-token, learnt from a codec."""

    def __init__(self, coder: BytePairCodec) -> None:
        self.coder, self.known = coder, {}

    def split(self, text: str) -> list[str]:
        return self.coder.pattern.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Takes up the counts of ``pieces``: all of them are known until the next call."""
        known = self.known
        if missing := [p for p in pieces if p not in known]:
            if len(known) + len(missing) > CACHE:
                known.clear()
                missing = [*pieces]
            words = [p.encode() for p in missing]
            known.update((p, len(x) // 4) for p, x in zip(missing, map(self.coder.merge_word, words) if len(words) < FEW else self.coder.merge_rows(words), strict=True))

    def counts(self, pieces: list[str]) -> list[int]:
        self.learn(set(pieces))
        return [*map(self.known.__getitem__, pieces)]

    def measured(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Characters and tokens of every pre-token of each text. The matrices of the encoder work best on many texts."""
        split = [*map(self.split, texts)]
        self.learn(set(chain.from_iterable(split)))
        return [(np.fromiter(map(len, p), np.int32, len(p)), np.fromiter(map(self.known.__getitem__, p), np.int32, len(p))) for p in split]


def _block_sizes(n: int) -> np.ndarray:
    """Pre-tokens of each block of ``n`` that are dealt anew; no pre-tokens make one empty block."""
    return np.diff(np.append(np.arange(0, n, BLOCK), n)) if n else np.zeros(1, np.int64)


def _nodes(leaves: np.ndarray) -> np.ndarray:
    """Sums of the binary tree above ``leaves``, by node; node 0 is not used."""
    level = np.zeros(1 << (len(leaves) - 1).bit_length(), np.int64)
    level[: len(leaves)] = leaves
    levels = [level]
    while len(level) > 1:
        level = level[0::2] + level[1::2]
        levels.append(level)
    return np.concatenate([np.zeros(1, np.int64), *reversed(levels)])


class CountTree:
    """The pre-tokens of one text in blocks below a binary tree of (characters, tokens).

    ``measured`` are the characters and tokens of its pre-tokens, or a whole tree as ``columns`` gives it; without them the
    text is split and counted. Pre-tokens of a block are cut from the text when an edit first touches it.
    """

    def __init__(self, text: str, counter: Counter, measured: tuple[np.ndarray, ...] | None = None) -> None:
        self.counter, self.reencoded = counter, 0
        self._take_up(text, *(measured or counter.measured([text])[0]))

    def _take_up(self, text: str, chars: np.ndarray, tokens: np.ndarray, sizes: np.ndarray | None = None, node_chars: np.ndarray | None = None, node_tokens: np.ndarray | None = None) -> None:
        """The blocks as slices of the text and its arrays, and the sums above them where they are not given: at the start,
        and when an edit has overfilled its blocks."""
        self.base, self.base_chars, self.base_tokens = text, chars, tokens
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(_block_sizes(len(chars)) if sizes is None else sizes)])
        if node_chars is None:
            node_chars, node_tokens = (_nodes(np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])[at])) for x in (chars, tokens))
        self.leaves = len(node_chars) // 2
        self.chars, self.tokens = node_chars.tolist(), node_tokens.tolist()
        self.piece_at, self.char_at = at.tolist(), [0, *np.cumsum(node_chars[self.leaves : self.leaves + len(at) - 1]).tolist()]
        self.taken: list[tuple[list[str], list[int]] | None] = [None] * (len(at) - 1)

    def _block(self, k: int) -> tuple[list[str], list[int]]:
        """Pre-tokens and counts of block ``k``."""
        if self.taken[k] is None:
            a, b, at, pieces = self.piece_at[k], self.piece_at[k + 1], self.char_at[k], []
            for n in self.base_chars[a:b].tolist():
                pieces.append(self.base[at : at + n])
                at += n
            self.taken[k] = pieces, self.base_tokens[a:b].tolist()
        return self.taken[k]

    @property
    def pieces(self) -> list[list[str]]:
        return [self._block(k)[0] for k in range(len(self.taken))]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def columns(self) -> tuple[str, tuple[np.ndarray, ...]]:
        """The text as it is, and its tree in the order of ``TREE``: what no edit touched is copied in runs."""
        texts, chars, tokens, sizes, at = [], [], [], np.diff(self.piece_at), 0
        for k in [*(k for k, b in enumerate(self.taken) if b is not None), len(self.taken)]:
            a, b = self.piece_at[at], self.piece_at[k]
            texts.append(self.base[self.char_at[at] : self.char_at[k]]), chars.append(self.base_chars[a:b]), tokens.append(self.base_tokens[a:b])
            if k < len(self.taken):
                pieces, counts = self.taken[k]
                texts += pieces
                chars.append(np.fromiter(map(len, pieces), np.int32, len(pieces))), tokens.append(np.array(counts, np.int32))
                sizes[k] = len(pieces)
            at = k + 1
        return "".join(texts), (np.concatenate(chars), np.concatenate(tokens), sizes, np.array(self.chars), np.array(self.tokens))

    def text(self) -> str:
        return self.columns()[0]

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (the last one for the end of the text), and where it begins."""
        i, begin = 1, 0
        at = min(at, self.chars[1] - 1)
        while i < self.leaves:
            i *= 2
            if at - begin >= self.chars[i]:
                begin += self.chars[i]
                i += 1
        return min(i - self.leaves, len(self.taken) - 1), begin

    def _update(self, k: int) -> None:
        i = self.leaves + k
        self.chars[i], self.tokens[i] = sum(map(len, self._block(k)[0])), sum(self._block(k)[1])
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replaces characters start to stop (code points, cut to the text's bounds) by ``replacement``."""
        start = max(0, min(start, self.n_chars))
        stop = max(start, min(stop, self.n_chars))
        first, begin = self._find(max(0, start - CONTEXT)) if self.n_chars else (0, 0)
        # In the first block, pre-tokens that end early enough stand; a block ends with a pre-token, so none before changes.
        keep = 0
        block = self._block(first)[0]
        while keep < len(block) and begin + len(block[keep]) + CONTEXT <= start:
            begin += len(block[keep])
            keep += 1
        last, old_end, step = first, begin + sum(map(len, block[keep:])), 1
        region = "".join(block[keep:])
        grown = len(replacement) - (stop - start)
        while True:
            whole = last + 1 >= len(self.taken)
            if old_end >= stop:
                new = region[: start - begin] + replacement + region[stop - begin :]
                pieces = self.counter.split(new)
                # Old boundaries behind the edit inside the region; from a common one on, both texts split alike, and the
                # old pre-tokens stand. The last new ones may look beyond a region that ends before the text does.
                old = [p for k in range(first, last + 1) for p in self._block(k)[0][keep if k == first else 0 :]]
                bounds, at = {}, begin
                for j, p in enumerate(old):
                    if at >= stop:
                        bounds[at + grown] = j
                    at += len(p)
                at, limit, met = begin, begin + len(new) - (0 if whole else CONTEXT), None
                for j, p in enumerate(pieces):
                    if at in bounds and at + len(p) <= limit:
                        met = j
                        break
                    at += len(p)
                if met is not None or whole:
                    break
            # The region doubles, so that an edit splits a bounded multiple of what it has to.
            for _ in range(min(step, len(self.taken) - 1 - last)):
                last += 1
                more = "".join(self._block(last)[0])
                region += more
                old_end += len(more)
            step *= 2
        fresh, kept = (pieces, []) if met is None else (pieces[:met], old[bounds[at] :])
        self.reencoded += sum(map(len, fresh))
        pieces = block[:keep] + fresh + kept
        known = [c for k in range(first, last + 1) for c in self._block(k)[1]]
        counts = known[:keep] + self.counter.counts(fresh) + known[len(known) - len(kept) :]
        if len(pieces) <= 2 * BLOCK * (last + 1 - first):
            # Spread over the blocks that they come from: the paths above these alone change.
            size = max(1, -(-len(pieces) // (last + 1 - first)))
            for k in range(first, last + 1):
                i = (k - first) * size
                self.taken[k] = pieces[i : i + size], counts[i : i + size]
                self._update(k)
        else:
            for k in range(first, last + 1):
                self.taken[k] = (pieces, counts) if k == first else ([], [])
            text, (chars, tokens, sizes, *_) = self.columns()
            self._take_up(text, chars, tokens, np.concatenate([sizes[:first], _block_sizes(len(pieces)), sizes[last + 1 :]]))


def derived_edits(docs: DataFrame, edits: str = "edits") -> DataFrame:
    """``docs`` with three edits each, derived from the text's length and doc_id: a deletion at a third, an insertion of
    the text's first words in the middle, and a replacement at the end. A null or empty text gets insertions alone."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    third, middle, some = F.floor(n / 3), F.floor(n / 2), F.expr("pmod(coalesce(doc_id, 0), 23)").cast("int")
    one = lambda a, b, r: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), r.alias("replacement"))
    head = F.substring(F.coalesce("text", F.lit("")), 1, 40)
    listed = F.array(one(third, third + some, F.lit("")), one(middle, middle, F.concat(F.lit(" "), head)), one(n - some, n + some, F.lit(" 'll end\n\n")))
    return docs.withColumn(edits, listed)


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """The integers of each list, None for a null list."""
    at, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] if there else None for a, b, there in zip(at, at[1:], column.is_valid().to_pylist(), strict=False)]


def _fits(text: str, tree: tuple[np.ndarray | None, ...]) -> bool:
    """Whether ``tree`` is one of ``text`` by its lengths and sums."""
    if any(x is None or x.dtype.kind != "i" for x in tree):
        return False
    chars, tokens, sizes, node_chars, node_tokens = tree
    if len(chars) != len(tokens) or sizes.sum() != len(chars) or not len(sizes) or len(node_chars) != len(node_tokens) or len(node_chars) != 2 << (len(sizes) - 1).bit_length():
        return False
    return node_chars[1] == len(text) == chars.sum() and node_tokens[1] == tokens.sum()


_COUNTS = ("n_tokens", "edited_n_tokens", "edited_n_chars", "n_edits", "reencoded_chars", "split_chars")


def _edited(docs: DataFrame, ranks_path: str, pattern: str, text: str, edits: str | None, keep: list[str] | None, stored: bool) -> DataFrame:
    treed = {(c, "array<int>") for c in TREE} <= {*docs.dtypes}
    inputs = [*([edits] if edits else []), *(TREE if treed else [])]

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        counter = held(("counter", ranks_path, pattern), lambda: Counter(BytePairCodec(ranks_path, pattern)))
        texts = [t or "" for t in part.column(text).to_pylist()]
        trees = [*zip(*(_lists(part.column(c)) for c in TREE), strict=True)] if treed else [None] * len(texts)
        trees = [x if x and _fits(t, x) else None for t, x in zip(texts, trees, strict=True)]
        # Texts without a tree of their own are split, and the pre-tokens of the whole slice learnt at once.
        fresh = iter(counter.measured([t for t, x in zip(texts, trees, strict=True) if x is None]))
        begun = [(x or next(fresh), 0 if x else len(t)) for t, x in zip(texts, trees, strict=True)]
        rows, grown = [], []
        for t, (measured, split), todo in zip(texts, begun, part.column(edits).to_pylist() if edits else [None] * len(texts), strict=True):
            tree = CountTree(t, counter, measured)
            before = tree.n_tokens
            for e in todo or ():
                if e is not None:
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
            rows.append((before, tree.n_tokens, tree.n_chars, len(todo or ()), tree.reencoded, split))
            if stored:
                grown.append(tree.columns())
        out = {n: pa.array(c, pa.int64()) for n, c in zip(_COUNTS, zip(*rows, strict=True), strict=True)}
        if stored:
            out[text] = pa.array([t for t, _ in grown], pa.string())
            for k, name in enumerate(TREE):
                lists = [x[k] for _, x in grown]
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                out[name] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists).astype(np.int32)))
        return out

    added = ", ".join(f"{c} bigint" for c in _COUNTS)
    if stored:
        added = f"`{text}` string, {', '.join(f'{c} array<int>' for c in TREE)}, {added}"
    return with_arrow(docs, kernel, added, text, keep, inputs)


def count_edits(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", edits: str = "edits", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens (of the text), edited_n_tokens and edited_n_chars (after its ``edits``, in their order, each
    in the positions of the text that the one before left), n_edits, reencoded_chars (characters that edits had
    encoded anew) and split_chars (characters of the text, if it had to be split; 0 if its tree was there).

    If ``docs`` has the columns of ``TREE`` (arrays of int), trees are taken from them; a row whose tree is null or does not fit its text by
    lengths and sums is split like one without. Null texts count as empty, null edits as none; positions beyond the text are
    cut to it, a null position or replacement counts as 0 or empty. Rows and other columns (or ``keep``) stay, apart from
    input columns named like the added ones. An empty table stays empty. No shuffle; a task holds the trees of one slice.
    """
    return _edited(docs, ranks_path, pattern, text, edits, keep, False)


def apply_edits(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", edits: str | None = "edits", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with their texts as edited, the columns of ``TREE`` that belong to them, and the counts of ``count_edits``.

    What it returns can be stored, and a later call takes it up with the next edits. Without ``edits`` (None) it makes the
    trees. Nulls, odd positions, clashing names and empty tables are as in ``count_edits``; a null text becomes an empty one.
    """
    return _edited(docs, ranks_path, pattern, text, edits, keep, True)
