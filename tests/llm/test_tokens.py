"""Byte-level BPE, Simple-8b and edit-aware counts against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, edit_counts, simple8b
from corvane.llm import queries_tokens as Q

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  ", "a\n b", "it's we'll 're '", "naïve 日本語 😀", "x" * 3000, "ab " * 900, " x　y\x85z\x1cq", "<|endoftext|>", "1234 56,7.8", "\t\ttab\r\n"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {p: i for i, p in enumerate(byte_bpe.pieces(RANKS)) if p}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.codec(RANKS, P.PATTERN)


def test_encodes_like_the_library(coder, library):
    got = coder.encode_packed([*ODD, None])
    for text, packed in zip([*ODD, ""], got, strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text), text
        assert byte_bpe.decode_packed(packed, coder.pieces) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t'abstrevdlm12é日!?-_., \x1c", max_size=40))
def test_encodes_like_the_library_on_any_text(text):
    import tiktoken

    c = byte_bpe.codec(RANKS, P.PATTERN)
    lib = test_encodes_like_the_library_on_any_text.__dict__.setdefault("lib", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={}))
    assert c.encode(text) == lib.encode_ordinary(text)
    assert "".join(byte_bpe.units(text)) == text


def test_matrix_and_heap_agree(coder):
    words = [("ab" * n)[:n].encode() for n in (1, 2, 3, 7, 31, 200, 512)]
    assert coder.merge_rows(words) == [coder.merge_word(w) for w in words]


def test_columns_and_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "hi there", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TOKEN_IDS string")
    got = byte_bpe.encode(docs, RANKS, P.PATTERN)
    assert got.columns == ["doc_id", "text", "token_ids"] and got.count() == 4
    assert sorted(len(r["token_ids"]) for r in got.collect()) == [0, 0, 0, 2]
    assert byte_bpe.encode(docs.where("false"), RANKS, P.PATTERN, packed=True).count() == 0


def test_op1(spark, library, tmp_path):
    spark.createDataFrame([*enumerate(ODD), (99, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in Q.op1_byte_bpe(spark, str(tmp_path)).collect():
        text = "" if r["doc_id"] == 99 else ODD[r["doc_id"]]
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 300), st.integers(0, 2**64 - 1)), max_size=500), st.sampled_from([1, 7, 64, 4096]))
def test_simple8b_round_trip(ids, block):
    v = np.array(ids, np.uint64)
    assert simple8b.decode_segment(simple8b.encode_segment(v, block)).tolist() == ids


def test_simple8b_packs_runs_and_refuses_other_bytes():
    assert len(simple8b.encode_segment(np.zeros(1200, np.uint64))) < 120
    with pytest.raises(ValueError, match="segment"):
        simple8b.decode_segment(b"nonsense")


def test_op4(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    more = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y <|endoftext|>", " lead", "nul\0 byte", "tail ", "word, word. it's we'll 12 Ġ ab\u00a0cd"]
    texts = [(5 * i, x) for i, x in enumerate([*ODD, *more])] + [(3, None)]
    spark.createDataFrame(texts[::-1], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in Q.op4_simple8b(spark, str(tmp_path)).collect()}
    start = 0
    for d, x in sorted(texts, key=lambda r: r[0]):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), d
        start += len(ids)


def test_library_ids_of_real_texts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect()]
    for whole in (True, False):
        coder = simple8b.LibraryTokenizer(JSON, split_units=whole)
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_packed(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tabstre,.'1éßĀƀͰ日!\x85\xa0", max_size=40))
def test_library_ids_of_any_text(text):
    coder = simple8b.tokenizer(JSON)
    assert np.frombuffer(coder.encode_packed([text])[0], "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_parts_of_plain_units():
    assert simple8b.plain_parts(" the") == [" the"] and simple8b.plain_parts(" end.\nThe,") == [" end", ".", "\n", "The", ","]
    assert [simple8b.plain_parts(u) for u in (" ", "", "\n", " a\n", " it's", " a..", "a\n b", " 日")] == [None] * 8


def test_shards_of_an_empty_table_and_small_segments(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simple8b.round_trip(empty, JSON).count() == 0
    docs = spark.createDataFrame([(i, "word " * i) for i in range(40)] + [(7, "again"), (None, "no id")], "doc_id long, text string")
    simple8b.write_shards(docs, str(tmp_path / "s"), JSON, segment_ids=10)
    rows = simple8b.read_shards(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert len(rows) == 42 and rows[0]["doc_id"] is None
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))


def test_edits_like_a_fresh_count(coder):
    counter = edit_counts.Counter(coder)
    rng = random.Random(3)
    parts = ["the", " ", "  ", "\n", "'", "'re", "re", "l", "1", "é", "!", "...", "\t", "stre"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randint(0, 120)))
        tree = edit_counts.CountTree(text, counter)
        for _ in range(5):
            a = rng.randint(0, len(text) + 2)
            b, new = a + rng.choice([0, 0, 1, 3, 20]), "".join(rng.choices(parts, k=rng.randint(0, 4)))
            tree.edit(a, b, new)
            a, b = min(a, len(text)), min(b, len(text))
            text = text[:a] + new + text[b:]
            assert tree.text() == text and [p for block in tree.pieces for p in block] == counter.split(text)
            assert tree.n_tokens == len(coder.encode(text)) and tree.n_chars == len(text)


def test_edits_touch_little_of_a_long_text(coder):
    text = "word and other words, " * 5000
    tree = edit_counts.CountTree(text, edit_counts.Counter(coder))
    tree.edit(50_000, 50_003, "XYZ")
    assert tree.reencoded < 1000 and tree.n_tokens == len(coder.encode(text[:50_000] + "XYZ" + text[50_003:]))


def test_blocks_split_and_the_end_of_a_text_is_kept(coder):
    counter = edit_counts.Counter(coder)
    text = "word and other words, " * 500
    tree = edit_counts.CountTree(text, counter)
    tree.edit(1000, 1000, "x y z " * 15_000)
    text = text[:1000] + "x y z " * 15_000 + text[1000:]
    assert max(map(len, tree.pieces)) <= 2 * edit_counts.BLOCK
    for at in (50_000, len(text) - 300):
        tree.reencoded = 0
        tree.edit(at, at + 1, "Q")
        text = text[:at] + "Q" + text[at + 1 :]
        assert tree.reencoded < 1000 and tree.text() == text and tree.n_tokens == len(coder.encode(text))


def test_op10(spark, coder, tmp_path):
    docs = spark.createDataFrame([*enumerate(ODD), (None, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = edit_counts.count_edits(edit_counts.derived_edits(docs), RANKS, P.PATTERN).collect()
    assert len(rows) == Q.op10_edit_counts(spark, str(tmp_path)).count() == len(ODD) + 1
    for r in rows:
        text = r["text"] or ""
        assert r["n_tokens"] == len(coder.encode(text))
        for e in r["edits"]:
            a, b = max(0, min(e["start"], len(text))), max(0, min(e["stop"], len(text)))
            text = text[:a] + e["replacement"] + text[max(a, b) :]
        assert (r["edited_n_tokens"], r["edited_n_chars"], r["n_edits"]) == (len(coder.encode(text)), len(text), 3)
    odd = docs.withColumn("edits", F.lit(None).cast(edit_counts.EDIT))
    assert {r["n_edits"] for r in edit_counts.count_edits(odd, RANKS, P.PATTERN).collect()} == {0}


def _edited(text: str, edits) -> str:
    for e in edits:
        a, b = max(0, min(e["start"], len(text))), max(0, min(e["stop"], len(text)))
        text = text[:a] + e["replacement"] + text[max(a, b) :]
    return text


def test_trees_are_stored_and_taken_up(spark, coder, tmp_path):
    long = "word and other words, 12 of them; " * 3000
    docs = spark.createDataFrame([*enumerate([*ODD, long]), (None, None)], "doc_id long, text string")
    first = edit_counts.apply_edits(edit_counts.derived_edits(docs), RANKS, P.PATTERN)
    first.write.parquet(str(tmp_path / "trees"))
    stored = spark.read.parquet(str(tmp_path / "trees")).drop("edits", "n_tokens")
    split = {"".join(p): p for p in map(coder.pattern.findall, [r["text"] for r in stored.collect()])}
    for r in stored.collect():
        pieces = split[r["text"]]
        assert r["piece_chars"] == [*map(len, pieces)] and r["piece_tokens"] == [len(coder.encode(p)) for p in pieces]
        assert sum(r["block_pieces"]) == len(pieces) and max(r["block_pieces"]) <= 2 * edit_counts.BLOCK
        assert r["node_chars"][1] == len(r["text"]) and r["node_tokens"][1] == r["edited_n_tokens"] == len(coder.encode(r["text"]))
        for nodes in (r["node_chars"], r["node_tokens"]):
            assert all(nodes[i] == nodes[2 * i] + nodes[2 * i + 1] for i in range(1, len(nodes) // 2))
    again = edit_counts.apply_edits(edit_counts.derived_edits(stored), RANKS, P.PATTERN).collect()
    before = {r["doc_id"]: r["text"] for r in stored.collect()}
    for r in again:
        assert r["text"] == _edited(before[r["doc_id"]], r["edits"]) and r["edited_n_tokens"] == len(coder.encode(r["text"]))
        assert r["split_chars"] == 0 and r["n_tokens"] == len(coder.encode(before[r["doc_id"]]))
    (whole,) = [r for r in again if len(r["text"]) > 50_000]
    assert whole["reencoded_chars"] < 1500
    counted = {r["doc_id"]: r for r in edit_counts.count_edits(edit_counts.derived_edits(stored), RANKS, P.PATTERN, keep=["doc_id"]).collect()}
    assert all(counted[r["doc_id"]]["edited_n_tokens"] == r["edited_n_tokens"] for r in again) and "text" not in counted[0]
    grown = spark.read.parquet(str(tmp_path / "trees"))
    assert {r["edited_n_tokens"] for r in grown.collect()} == {r["node_tokens"][1] for r in edit_counts.apply_edits(grown, RANKS, P.PATTERN, edits=None).collect()}


def test_trees_that_do_not_fit_are_made_anew(spark, coder):
    docs = spark.createDataFrame([(1, "some words, here"), (2, "others"), (3, None)], "doc_id long, text string")
    trees = edit_counts.apply_edits(docs, RANKS, P.PATTERN, edits=None, keep=["doc_id"])
    assert {r["split_chars"] for r in trees.collect()} == {16, 6, 0} and edit_counts.apply_edits(docs.where("false"), RANKS, P.PATTERN, edits=None).count() == 0
    other = trees.withColumn("text", F.when(F.col("doc_id") == 1, "quite other words of another length").otherwise(F.col("text")))
    nulled = other.withColumn("node_tokens", F.when(F.col("doc_id") != 2, F.col("node_tokens")))
    for r in edit_counts.count_edits(edit_counts.derived_edits(nulled), RANKS, P.PATTERN).collect():
        assert r["n_tokens"] == len(coder.encode(r["text"])) and r["split_chars"] == len(r["text"])
        assert r["edited_n_tokens"] == len(coder.encode(_edited(r["text"], r["edits"])))
    clash = docs.withColumn("piece_chars", F.lit("x")).withColumn("N_Tokens", F.lit(1))
    assert edit_counts.apply_edits(edit_counts.derived_edits(clash), RANKS, P.PATTERN).count() == 3


def test_op10_second_batch(spark, coder, tmp_path):
    docs = spark.createDataFrame([*enumerate(ODD), (None, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first = edit_counts.apply_edits(edit_counts.derived_edits(docs), RANKS, P.PATTERN, keep=["doc_id"])
    after = {r["doc_id"]: _edited(r["text"], r["edits"]) for r in edit_counts.derived_edits(first).collect()}
    for r in Q.op10_edit_counts(spark, str(tmp_path)).collect():
        assert (r["again_n_tokens"], r["again_n_chars"], r["again_split_chars"]) == (len(coder.encode(after[r["doc_id"]])), len(after[r["doc_id"]]), 0)
