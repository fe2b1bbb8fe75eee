"""Token-id shards in Simple-8b word-aligned coding.

A block holds up to ``BLOCK_IDS`` ids in 64-bit words. The upper four bits of a word are its selector: how many ids
follow, in how many bits each. A value of more than 60 bits is escaped: a word with the escape selector, then the value
as a raw word; a block lists the places of its raw words, so that all other words decode at once with numpy. A segment
is a run of blocks behind a table of their offsets. Shards are Parquet tables of segments with the documents that each
holds, in ascending order of ids, so that Spark writes and reads them on any store.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.byte_bpe import cached, units
from corvane.llm.common import fresh_path, held, map_arrow, sliced

# Fixed values of the code: ids in a word and bits of each, by selector; selector 0 marks an escape, selectors 1 to 15 pack.
COUNTS = (0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

#: Values from which the selectors 1 to 15 do not suffice.
LIMITS = np.array([1 << b for b in BITS[1:]], np.uint64)
MAGIC = b"S8B1"
BLOCK_IDS = 4096
#: Ids of a segment, about; a longer document has a segment to itself.
SEGMENT_IDS = 1 << 18
#: Entries of a worker's cache of encoded units: about 200 bytes each.
CACHE_UNITS = 1_000_000
#: Letters below this code point are the same in every version of Unicode.
PLAIN = "\u0180"
#: Units that the library encodes in one string.
JOINED = 2000


def choose(v: np.ndarray, block_ids: int) -> np.ndarray:
    """The fullest selector at each place: the one whose run of small enough values, cut at the block's end, suffices; 0
    where an escape is needed."""
    n = len(v)
    needed = np.full(-(-n // block_ids) * block_ids, 16, np.int8)
    needed[:n] = np.searchsorted(LIMITS, v, side="right") + 1
    most = needed.reshape(-1, block_ids)  # of the ``count`` values from each place
    choice, count = np.zeros_like(most), 1
    for s in range(15, 0, -1):
        if COUNTS[s] > block_ids:
            break
        while count < COUNTS[s]:
            step = min(count, COUNTS[s] - count)
            most, count = np.maximum(most[:, :-step], most[:, step:]), count + step
        fits = most <= s
        if not fits.any():
            break  # longer runs of smaller values fit even less
        choice[:, : fits.shape[1]][fits] = s
    return choice.ravel()[:n]


def encode_blocks(values: np.ndarray, block_ids: int = BLOCK_IDS) -> list[bytes]:
    """Blocks of ``block_ids`` values: header (ids, words, escapes as u32), places of raw words (u32), then the words."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return []
    ends = np.minimum(np.arange(block_ids, n + block_ids, block_ids), n)
    padded = np.concatenate([v, np.zeros(max(COUNTS), np.uint64)])
    choice = choose(v, block_ids)
    step = np.where(choice == 0, 1, np.asarray(COUNTS)[choice]).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.asarray(starts, np.int64)
    kind = choice[at]
    escaped = kind == 0
    slot = np.arange(len(at)) + np.cumsum(escaped) - escaped  # an escape takes two words
    words = np.zeros(len(at) + int(escaped.sum()), np.uint64)
    for s in range(1, 16):
        k = np.flatnonzero(kind == s)
        if len(k):
            word = np.full(len(k), s << 60, np.uint64)
            if BITS[s]:
                for j in range(COUNTS[s]):
                    word |= padded[at[k] + j] << np.uint64(BITS[s] * j)
            words[slot[k]] = word
    raw = slot[escaped] + 1
    words[raw] = v[at[escaped]]
    bounds = [0, *np.append(slot, len(words))[np.searchsorted(at, ends)].tolist()]
    blocks = []
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own = raw[np.searchsorted(raw, a) : np.searchsorted(raw, b)] - a
        size = int(ends[k]) - k * block_ids
        blocks.append(np.array([size, b - a, len(own)], "<u4").tobytes() + own.astype("<u4").tobytes() + words[a:b].astype("<u8").tobytes())
    return blocks


def decode_block(data: bytes | memoryview) -> np.ndarray:
    n, n_words, n_raw = np.frombuffer(data, "<u4", 3).tolist()
    raw = np.frombuffer(data, "<u4", n_raw, 12).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, 12 + 4 * n_raw)
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = np.asarray(COUNTS)[kind]
    count[raw] = 1
    kind[raw] = -1
    count[raw - 1] = 0
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - count
    for s in range(1, 16):
        k = np.flatnonzero(kind == s)
        if len(k) and BITS[s]:
            shift = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])
            got = words[k][:, None] >> shift & np.uint64((1 << BITS[s]) - 1)
            out[starts[k][:, None] + np.arange(COUNTS[s])] = got
    out[starts[raw]] = words[raw]
    return out[:n]


def encode_segment(values: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """Magic, number of blocks (u32), ends of the blocks in bytes (u64 each), blocks."""
    blocks = encode_blocks(values, block_ids)
    ends = np.cumsum([len(b) for b in blocks], dtype=np.int64) if blocks else np.zeros(0, np.int64)
    return b"".join([MAGIC, np.array([len(blocks)], "<u4").tobytes(), ends.astype("<u8").tobytes(), *blocks])


def decode_segment(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    count = int(np.frombuffer(data, "<u4", 1, 4)[0])
    ends = np.frombuffer(data, "<u8", count, 8).tolist()
    body = memoryview(data)[8 + 8 * count :]
    parts = [decode_block(body[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if count else []
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def letters() -> str:
    """The letter of each byte in byte-level vocabularies: a printable byte's own, the others have U+0100 and the next."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(others)) for b in range(256))


LETTERS = letters()
SPACE = LETTERS[32]


def plain_parts(unit: str) -> list[str] | None:
    """The pre-tokens of a unit of words, each with at most a comma or a full stop behind it, and single line breaks between
    them; None for any other unit."""
    if not unit.isascii() and max(unit) >= PLAIN:
        return None
    parts = []
    for i, line in enumerate(unit.split("\n")):
        if i:
            parts.append("\n")
        word = line[1:] if not i and line[:1] == " " else line
        if word.isalpha():
            parts.append(line)
        elif word[-1:] in (",", ".") and word[:-1].isalpha():
            parts += line[:-1], word[-1]
        else:
            return None
    return parts


class LibraryTokenizer:
    """Ids of whole texts by a file of the tokenizers library, as its ``encode(..., add_special_tokens=False)`` gives them:
    a string of an added token in a text becomes that token.

    ``split_units``: the file's splitter is the byte-level one, which never matches across the boundaries of ``units()``,
    and no added token holds a space or consists of letters. Pre-tokens of plain words are then encoded by the library's
    model, other units that are not in the cache by the whole library in strings of many; as each id stands for a known
    number of bytes, the units' ids are found by place. Otherwise texts are encoded whole.
    """

    def __init__(self, json_path: str, split_units: bool = True) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        self.model = self.library.model
        self.split_units = split_units
        self.cache: dict[str, bytes] = {}
        # A token of a byte-level vocabulary has a character for each byte, an added token is its own text.
        words = {i: len(w) for w, i in self.library.get_vocab(with_added_tokens=False).items()}
        words |= {i: len(t.content.encode()) for i, t in self.library.get_added_tokens_decoder().items()}
        self.width = np.zeros(max(words) + 1, np.int64)
        self.width[[*words]] = [*words.values()]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_token(self, piece: str) -> bytes:
        """Ids of one pre-token: the library's model needs no splitter for it, but the vocabulary's letters."""
        if piece.isascii() and piece != "\n":  # their printable characters stand for themselves
            spelt = piece.replace(" ", SPACE)
        else:
            spelt = piece.encode().decode("latin-1").translate(LETTERS)
        ids = [t.id for t in self.model.tokenize(spelt)]
        return pack(f"<{len(ids)}I", *ids)

    def _learn(self, missing: set[str]) -> None:
        cache, whole, others, joined, alone = self.cache, self._pre_token, [], [], []
        for u in missing:
            if (u[1:] if u[0] == " " else u).isalpha() and (u.isascii() or max(u) < PLAIN):
                cache[u] = whole(u)
            else:
                others.append(u)
        for u in others:
            if parts := plain_parts(u):
                for part in parts:
                    if part not in cache:
                        cache[part] = whole(part)
                cache[u] = b"".join([cache[part] for part in parts])
            elif u[0] != " " or u[-1].isspace():
                alone.append(u)
            else:
                joined.append(u)
        cache.update((u, ids.tobytes()) for u, ids in zip(alone, self._whole(alone), strict=True))
        # A unit that begins with its space and ends with none can stand behind another one.
        groups = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        for group, ids in zip(groups, self._whole(["".join(g) for g in groups]), strict=True):
            ends = np.cumsum([len(u.encode()) for u in group])
            places = np.cumsum(self.width[ids])
            at = np.searchsorted(places, ends) + 1
            if not np.array_equal(places[at - 1], ends):
                raise ValueError("a token crosses the boundary of a unit: use split_units=False for this tokenizer")
            packed, at = ids.tobytes(), (4 * at).tolist()
            cache.update((u, packed[a:b]) for u, a, b in zip(group, [0, *at[:-1]], at, strict=True))

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text counts as empty."""
        if not self.split_units:
            return [ids.tobytes() for ids in self._whole([t or "" for t in texts])]
        cut = [units(t or "") for t in texts]
        return cached(cut, self.cache, self._learn, CACHE_UNITS)


def tokenizer(json_path: str, split_units: bool = True) -> LibraryTokenizer:
    """The tokenizer that a worker process keeps, with its cache."""
    return held(("tokenizer", json_path, split_units), lambda: LibraryTokenizer(json_path, split_units))


#: Columns of a shard table.
SHARD = "shard int, segment long, first long, doc_ids array<bigint>, n_tokens array<bigint>, payload binary"


def write_shards(docs: DataFrame, path: str, json_path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS, split_units: bool = True) -> None:
    """Encodes each text, appends ``end_id`` and writes the ids in ascending order of ``doc_id`` (null first) to ``path``.

    One range shuffle of the texts; each range is a shard that streams into segments, so a task holds one segment and one
    slice of texts. Null texts count as empty: ``end_id`` alone. Rows that share a doc_id are all written, next to each
    other. An empty table makes an empty shard table. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = tokenizer(json_path, split_units)
        end = np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        held: list[bytes] = []
        total = first = segment = 0

        def flush() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(held), "<u4")
            row = [[shard], [segment], [first], [ids], [[len(x) // 4 for x in held]], [encode_segment(values)]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "segment", "first", "doc_ids", "n_tokens", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for part in sliced(batch, text):
                for d, packed in zip(part.column(doc_id).to_pylist(), encoder.encode_packed(part.column(text).to_pylist()), strict=True):
                    ids.append(d), held.append(packed + end)
                    total += len(packed) // 4 + 1
                    if total >= segment_ids:
                        yield flush()
                        first, segment, total, ids, held = first + total, segment + 1, 0, [], []
        if held:
            yield flush()

    frame = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias(text))
    ordered = frame.repartitionByRange(F.col(doc_id).asc_nulls_first()).sortWithinPartitions(F.col(doc_id).asc_nulls_first())
    map_arrow(ordered, run, SHARD).write.option("compression", "zstd").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """One row for each document of the shards at ``path``: doc_id, start (ids of all documents before it), n_tokens and
    token_ids (little-endian u32 bytes), decoded from the segments' payloads."""
    segments = spark.read.schema(SHARD).parquet(path)
    # One row for each shard: as many as the writer had ranges, whatever the number of documents.
    totals = segments.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("shard", before.alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                packed = decode_segment(row["payload"]).astype("<u4").tobytes()
                sizes = np.asarray(row["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(sizes), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["first"]), pa.array(sizes), pa.array([packed[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)], pa.binary())],
                    names=["shard", "doc_id", "offset", "n_tokens", "token_ids"],
                )

    rows = map_arrow(segments, run, "shard int, doc_id bigint, offset bigint, n_tokens bigint, token_ids binary")
    # One row for each range of the writer, a bound that the session sets: the rows with their ids need no shuffle.
    return rows.join(F.broadcast(starts), "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "token_ids")


def round_trip(docs: DataFrame, json_path: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` as shards in the shared folder and returns what ``read_shards`` finds there."""
    path = fresh_path(docs.sparkSession, "simple8b")
    write_shards(docs, path, json_path, end_id)
    return read_shards(docs.sparkSession, path)
