"""Operators on hand-derived cases."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions import json as J
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import chunking, encoding, evaluation, expansion, fusion, index, matching, prediction, rendering, scoring, validation
from corvane.plans import queries, retrieval, search


def values(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


@pytest.mark.parametrize(("text", "expected"), [("Mức lương_cơ sở 12,5%", ["mức", "lương_cơ", "sở", "12", "5"]), ("a²b ½ Ⅳ ٣", ["a²b", "½", "ⅳ", "٣"]), ("a‍b", ["a", "b"]), (None, [])])
def test_tokens(spark, text, expected):
    assert values(spark, [(text,)], "t string").select(T.tokens("t")).first()[0] == expected


def test_clean_and_title(spark):
    row = values(spark, [(" a\t b\r\n\n\n c  ", "luat-dat-dai", None), ("", None, "http://h/x/nghi-dinh-5-2020-123.aspx")], "t string, n string, l string")
    got = row.select(T.clean("t"), T.title("n", "l")).collect()
    assert got[0][0] == "a b\n c" and got[0][1] == "luat dat dai" and got[1][1] == "nghi dinh 5 2020"


@pytest.mark.parametrize(("n", "starts"), [(0, []), (256, [0]), (257, [0, 192]), (448, [0, 192]), (449, [0, 192, 384]), (1000, [0, 192, 384, 576, 768])])
def test_windows(spark, n, starts):
    text = " ".join(f"w{i}" for i in range(n))
    got = values(spark, [(text,)], "t string").select(chunking.windows(F.col("t"))).first()[0]
    assert [int(w.split()[0][1:]) for w in got if w] == starts
    if n:
        assert got[-1].split()[-1] == f"w{n - 1}"


@pytest.mark.parametrize(("sizes", "groups"), [([40, 5, 50], [[0, 1], [2]]), ([5, 40], [[0, 1]]), ([5], [[0]]), ([31, 1, 40], [[0, 1], [2]]), ([20, 5, 40, 3], [[0, 1, 2, 3]])])
def test_merge_small(spark, sizes, groups):
    pieces = values(spark, [([(f"Khoản {i}", " ".join([f"p{i}"] * n)) for i, n in enumerate(sizes)],)], "p array<struct<label: string, body: string>>")
    got = [sorted({int(w[1:]) for w in r["body"].split()}) for r in pieces.select(chunking.merge_small(F.col("p"))).first()[0]]
    assert got == groups
    assert pieces.select(chunking.merge_small(F.slice("p", 1, 0))).first()[0] == []


def test_too_many_chunks_are_an_error(spark):
    with pytest.raises(Exception, match="more than 1048576 chunks in document 7"):
        chunking.with_index(values(spark, [(7, 1 << 20)], "doc_id long, ordinal int")).collect()


def test_chunks_need_no_shuffle(spark):
    docs = values(spark, [(1, "n", None, "x")], "doc_id long, name string, link string, passage string")
    plan = chunking.chunk(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan


@pytest.mark.parametrize(("a", "b", "c"), [("Khoản 1", "Khoản 1", "Khoản 1"), ("Khoản 1", "Khoản 3", "Khoản 1-3"), ("Phần mở đầu", "Điều 1", "Phần mở đầu + Điều 1"), ("Điều 1", "Điều 12a", "Điều 1 + Điều 12a")])
def test_merged_label(spark, a, b, c):
    assert values(spark, [(a, b)], "a string, b string").select(chunking.merged_label(F.col("a"), F.col("b"))).first()[0] == c


@pytest.mark.parametrize(("text", "n"), [("Điều 1. a\nĐiều 2. b", 2), ("x Điều 1. a", 0), ("Điều 1\n Điều 3. x", 1), ("abc Điều 1", 0)])
def test_article_marks(spark, text, n):
    assert values(spark, [(text,)], "t string").select(F.size(chunking.marked_pieces(F.col("t"), chunking.ARTICLE)) - 1).first()[0] == n


def test_structural_chunks(spark):
    w = lambda p, n: " ".join([p] * n)
    text = f"Điều 1. Phạm vi\n{w('a', 40)}\nĐiều 2. Dài\n1. {w('b', 200)}\n2. {w('c', 200)}\nĐiều 3. Rất dài\n{w('d', 500)}"
    docs = values(spark, [(7, "luat-x", None, text), (8, "chỉ-tên", None, " "), (9, None, None, None), (10, None, None, "ngắn")], "doc_id long, name string, link string, passage string")
    got = {r["chunk_id"]: r for r in chunking.chunk(docs).collect()}
    assert got["8#t0"]["tier"] == 0 and got["8#t0"]["text"] == "chỉ tên"
    assert not any(k.startswith("9#") for k in got)
    assert got["10#0"]["tier"] == 3 and got["10#0"]["text"] == "Phần 1\nngắn"
    paths = [got[f"7#{i}"]["path"] for i in range(len([k for k in got if k.startswith("7#")]))]
    assert paths == ["Điều 1", "Điều 2 > Khoản 1", "Điều 2 > Khoản 2", "Điều 3 > phần 1", "Điều 3 > phần 2", "Điều 3 > phần 3"]
    assert got["7#2"]["text"].startswith("luat x > Điều 2 > Khoản 2\nĐiều 2. Dài\n2. c")
    assert [got[f"7#{i}"]["tier"] for i in range(3)] == [1, 2, 2]


CORPUS = [(0, 10, "phí căn cước phí"), (1, 10, "căn cước công dân"), (2, 20, "thời hạn phí"), (3, 30, "công dân"), (4, 30, "hồ sơ dân"), (5, 20, "hồ sơ thời hạn")]


@pytest.fixture(scope="module")
def idx(spark):
    return index.build(values(spark, CORPUS, "chunk_idx long, doc_id long, text string"))


def test_index(idx):
    row = idx.corpus_stats.first()
    assert (row["n_chunks"], round(row["avgdl"], 6), row["nnz"], row["vocab_size"]) == (6, 3.333333, 19, 9)
    assert {r["term"]: r["df"] for r in idx.vocab.collect()}["dân"] == 3


@pytest.mark.parametrize(("question", "chunks", "top3"), [("phí căn cước", {0: 3.280669, 1: 1.824642, 2: 1.100357}, [(10, 2.552656), (20, 1.100357)]), ("phí phí", {0: 2.912055, 2: 2.200713}, [(10, 2.912055), (20, 2.200713)]), ("zzz", {}, [])])
def test_bm25(spark, idx, question, chunks, top3):
    asked = values(spark, [(1, question)], "qid long, question string")
    scores = scoring.score(idx, asked)
    assert {r["chunk_idx"]: round(r["score"], 6) for r in scores.collect()} == chunks
    got = scoring.search_docs(idx, asked, agg="top3").orderBy("rnk").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in got] == top3


def test_index_round_trip(spark, idx, tmp_path):
    index.write(idx, str(tmp_path / "i"))
    asked = values(spark, [(1, "phí")], "qid long, question string")
    assert scoring.score(index.read(spark, str(tmp_path / "i")), asked).count() == 2


def test_fusion(spark):
    pool = values(spark, [(1, 0, 10, 0.5, 1.0), (1, 1, 10, 0.0, 0.0), (1, 2, 20, 1.0, 0.0)], "qid long, chunk_idx long, doc_id long, score double, dense double")
    linear = {r["chunk_idx"]: r["fused"] for r in fusion.fuse(pool, "linear", 0.7).collect()}
    assert linear[0] == pytest.approx(0.85)
    rrf = {r["chunk_idx"]: r["fused"] for r in fusion.fuse(pool, "rrf").collect()}
    assert rrf[0] == pytest.approx(1 / 62 + 1 / 61)
    flat = values(spark, [(1, i, 1, 3.0, 3.0) for i in range(3)], "qid long, chunk_idx long, doc_id long, score double, dense double")
    assert {r["fused"] for r in fusion.fuse(flat, "linear").collect()} == {0.0}


def test_rerank_candidates(spark):
    fused = values(spark, [(1, i, "ABACADB".index(d), float(9 - i)) for i, d in enumerate("ABACADB")], "qid long, chunk_idx long, doc_id long, fused double")
    got = {r["chunk_idx"] for r in fusion.rerank_candidates(fused, 3, 3).collect()}
    assert got == {0, 1, 2, 3, 4}


def test_vectors(spark):
    row = values(spark, [([3.0, 4.0, 9.0], [0.0, 0.0])], "a array<float>, z array<float>").select(V.truncated(F.col("a"), 2), V.truncated(F.col("z"), 2), V.mean_pooled(F.array(F.array(F.lit(1.0)), F.array(F.lit(3.0))), F.array(F.lit(1), F.lit(0)))).first()
    assert row[0] == pytest.approx([0.6, 0.8]) and row[1] == [0.0, 0.0] and row[2] == [1.0]


def test_expansion(spark):
    asked = values(spark, [(1, "mức phạt 5 triệu cho CCCD")], "qid long, question string")
    made = expansion.expand_rules(asked).first()
    assert made["expansion_terms"][:2] == ["căn cước công dân", "xử phạt"]
    proposed = asked.withColumn("normalized_query", F.lit(None).cast("string")).withColumn("expansion_terms", F.array(*map(F.lit, ["phạt tiền 5 triệu", "phạt 10 triệu", "điều 5", "context_5", "a b c d e f g", " Phạt  tiền 5 TRIỆU "])))
    assert expansion.filter_expansions(proposed).first()["expansion_terms"] == ["phạt tiền 5 triệu"]
    text = expansion.expanded_queries(asked, expansion.expand_rules(asked)).first()["question"]
    assert text.count("căn cước công dân") == 3


def test_padding_and_metrics(spark):
    asked = values(spark, [(1, "q")], "qid long, question string")
    ranked = values(spark, [(1, "a", 1), (1, "b", 2)], "qid long, doc_id string, rnk int")
    spare = values(spark, [(x, i) for i, x in enumerate("bcdef", 1)], "doc_id string, place int")
    rows = prediction.padded(asked, ranked, spare)
    assert prediction.answers(rows).first()["answer"] == list("abcde")
    gold = values(spark, [(1, "a"), (1, "b")], "qid long, doc_id string")
    pred = values(spark, [(1, d, i) for i, d in enumerate("xayzw", 1)], "qid long, doc_id string, rnk int")
    row = evaluation.per_question(pred, gold).first()
    assert (row["recall"], row["precision"], row["hit"], row["rr"]) == (0.5, 0.2, 1.0, 0.5)
    none = evaluation.per_question(pred.where("false"), gold).first()
    assert (none["recall"], none["precision"], none["hit"], none["rr"]) == (0.0, 0.0, 0.0, 0.0)


def test_validation(spark):
    text = '{"1":{"answer":null},"2":{"answer":"x"},"3":{},"4":5,"5":{"answer":[7]},"6":{"answer":[" "]},"7":{"answer":["a","a"]},"8":{"answer":[]},"9":{"answer":["a","b","c","d","e","f"]},"9":{"answer":["zz"]},"extra":{"answer":["a"]}}'
    subs = values(spark, [("s", text), ("bad", "{"), ("list", "[]"), ("empty", "{}")], "sub_id string, json string")
    found = validation.findings(subs, values(spark, [(str(i),) for i in range(1, 11)], "qid string"), values(spark, [("a",), ("b",)], "doc_id string"))
    codes = {}
    for r in found.collect():
        codes.setdefault(r["sub_id"], {})[r["code"]] = r["n"]
    assert codes["s"] == {"E009": 2, "E008": 1, "E007": 1, "E010": 1, "E011": 1, "E012": 1, "W001": 1, "E013": 1, "E014": 1, "E005": 1, "E006": 1}
    assert "E003" in codes["bad"] and "E004" in codes["list"] and "E004" in codes["empty"]


def test_unreadable_submissions_miss_no_question(spark):
    subs = values(spark, [("text", "no json"), ("list", "[1]"), ("empty", "{}"), ("nan", '{"1": NaN}'), ("twice", '{"1":{"answer":["1","1","2","2"]}}')], "sub_id string, json string")
    found = validation.findings(subs, values(spark, [("1",), ("2",)], "qid string")).collect()
    assert {(r["sub_id"], r["code"], r["n"]) for r in found} == {("text", "E003", 1), ("list", "E004", 1), ("empty", "E004", 1), ("nan", "E003", 1), ("twice", "E012", 1), ("twice", "E005", 1)}
    assert next(r["examples"] for r in found if r["sub_id"] == "nan") == ["NaN is no value"]
    lengths = validation.length_distribution(subs).collect()
    assert [tuple(r) for r in lengths] == [("twice", 4, 1)]


def test_report_and_statistics(spark):
    files = values(spark, [("a", None, [("E001", "a.zip")]), ("b", '{"1":\n {"answer" ["x"]}}', [("W004", "b.json")]), ("c", '{"1":{"answer":["a","b"]},"2":{"answer":["a"]},"3":5}', [])], "sub_id string, json string, file_findings array<struct<code: string, detail: string>>")
    got = {(r["sub_id"], r["code"]): (r["title"], r["n"], r["examples"]) for r in validation.report(files, corpus=values(spark, [("a",)], "doc_id string")).collect()}
    assert set(got) == {("a", "E001"), ("b", "W004"), ("b", "E003"), ("b", "W005"), ("c", "E007"), ("c", "E014"), ("c", "W005")}
    assert got["b", "E003"][2] == ["line 2, column 12"] and got["a", "E001"] == (validation.TITLES["E001"], 1, ["a.zip"]) and got["c", "E014"][1:] == (1, ["b"])
    row = validation.statistics(files.where("sub_id = 'c'")).first()
    assert (row["n_questions"], row["n_answers"], row["n_ids"], row["n_documents"]) == (3, 2, 3, 2)


def test_examples_are_five(spark):
    subs = values(spark, [("s", '{"x": 1}')], "sub_id string, json string")  # an empty object breaks E004 alone
    asked = values(spark, [(str(i),) for i in range(10, 30)], "qid string")
    row = validation.findings(subs, asked).where("code = 'E005'").first()
    assert row["n"] == 20 and row["examples"] == ["10", "11", "12", "13", "14"]


def test_best_delta_matrix(spark):
    rows = values(spark, [(1.0, 0.1, 0.5), (1.0, 0.2, 0.7), (2.0, 0.1, 0.7), (2.0, 0.2, 0.4)], "k1 double, b double, recall double")
    top = evaluation.best(rows, ["k1", "b"]).first()
    assert (top["k1"], top["b"]) == (1.0, 0.2)
    assert {(r["k1"], r["b"]): round(r["delta"], 6) for r in evaluation.deltas(rows, F.col("k1") + F.col("b") == 1.1).collect()} == {(1.0, 0.1): 0.0, (1.0, 0.2): 0.2, (2.0, 0.1): 0.2, (2.0, 0.2): -0.1}
    assert {r["k1"]: (r["0.1"], r["0.2"]) for r in evaluation.matrix(rows, "k1", "b", [0.1, 0.2]).collect()} == {1.0: (0.5, 0.7), 2.0: (0.7, 0.4)}


def test_document_view(spark):
    docs = values(spark, [(1, "luat-x", None, "1. abc."), (2, None, None, None)], "doc_id long, name string, link string, passage string")
    asked = values(spark, [(1,), (1,), (2,), (3,)], "doc_id long")
    got = {r["doc_id"]: (r["found"], r["name"], r["html"]) for r in rendering.document_view(asked, docs, ["abc"]).collect()}
    assert got[1] == (True, "luat x", '<p class="khoan">1. <mark>abc</mark>.</p>') and got[2][0] and got[2][2] == '<p class="empty"></p>' and got[3] == (False, None, None)


def test_texts_of_chunks_are_not_shuffled_to_a_reranker(spark):
    """candidates are known to be few before the chunks' texts are read."""
    sf, seen, name = "/root/testdata/sf0.001", [], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "100k")
    try:
        idx, chunks = retrieval.corpus_index(spark, sf), retrieval.corpus_chunks(spark, sf)

        def rerank(pairs):
            seen.append((pairs.columns, pairs._jdf.queryExecution().executedPlan().toString()))
            return pairs.withColumn("logit", F.col("fused"))

        ranked = retrieval.ranked_docs(idx, retrieval.questions(spark, sf), retrieval.Options(), retrieval.stand_in_vectors(spark, sf), chunks=chunks, rerank=rerank)
        assert ranked.count() > 0
    finally:
        spark.conf.set(name, before)
    assert seen[0][0] == ["qid", "chunk_idx", "doc_id", "fused", "question", "text"]
    assert seen[0][1].count("BroadcastHashJoin") == 2 and "hashpartitioning" not in seen[0][1]


def test_a_reranker_sees_the_whole_pool(spark):
    """it saw the chunks of three documents, three of each, and a pair's first 512 tokens."""
    sf = "/root/testdata/sf0.001"
    pool = retrieval.dense_pool(queries._index(spark, sf), retrieval.questions(spark, sf), *retrieval.stand_in_vectors(spark, sf), retrieval.Options())
    wanted = {(r["qid"], r["doc_id"]): r["n"] for r in pool.groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(r["qid"], r["doc_id"]): r["n_chunk"] for r in queries._reranked(spark, sf, 10**6).collect()} == wanted and max(wanted.values()) > 3
    pairs = values(spark, [(1, "a " * 600 + "b", "x " * 600 + "b")], "qid long, question string, text string")
    assert queries._reranker(pairs).first()["logit"] == 0.5


def test_a_long_line_is_searched_once(spark):
    """the pattern of line ends began anew at each character of a line, a square of its length."""
    began = time.monotonic()
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("ab "), 130_000), F.lit("x\ny;)\nz")).alias("text"))
    lines = rendering.reflow(docs, ["doc_id"]).orderBy("line_no").select(F.length("line"), F.right("line", F.lit(5))).collect()
    assert [tuple(r) for r in lines] == [(390_005, "x y;)"), (1, "z")]
    assert time.monotonic() - began < 20


@pytest.mark.parametrize(("terms", "text", "expected"), [
    (["in", "the", "there"], "In there, THE thein in_ inn \u0130n the", "<mark>In</mark> <mark>there</mark>, <mark>THE</mark> thein in_ inn <mark>\u0130n</mark> <mark>the</mark>"),
    (["]a", "^", "đ"], "x]a ]a ^ Đ đa", "x]a <mark>]a</mark> <mark>^</mark> <mark>Đ</mark> đa"),
])
def test_highlight_looks_at_first_letters(spark, terms, text, expected):
    """neither the letter's case nor a sign that classes of characters know changes what is marked."""
    assert values(spark, [(text,)], "t string").select(rendering.highlight(F.col("t"), terms)).first()[0] == expected


def test_reflow_and_render(spark):
    docs = values(spark, [(1, "Điều 1. Phạm\nvi điều chỉnh\n-----\n1. abc.\nx <b>")], "doc_id long, text string")
    assert [r["line"] for r in rendering.reflow(docs, ["doc_id"]).orderBy("line_no").collect()] == ["Điều 1. Phạm vi điều chỉnh", "1. abc.", "x <b>"]
    html = rendering.render(docs.withColumnRenamed("text", "passage"), ["phạm", "x"]).first()["html"]
    assert html == "<h3 id='dieu-1'>Điều 1. <mark>Phạm</mark> vi điều chỉnh</h3>\n<p class=\"khoan\">1. abc.</p>\n<p><mark>x</mark> &lt;b&gt;</p>"


def test_json_recovery(spark):
    rows = values(spark, [('{"a":1}',), ('so: {"a":2} ok',), ("none",)], "t string").select(J.recovered(F.col("t"), "a long")["a"]).collect()
    assert [r[0] for r in rows] == [1, 2, None]


def test_short_passages_are_found(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma delta"), (3, "x alphabet beta gammas"), (4, "one two three four")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "one two three"), (4, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r["qid"], r["doc_id"]) for r in retrieval.gold(spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (1, 3), (2, 2), (2, 3), (3, 4)}


def test_private_characters_stay_in_their_pieces(spark):
    text = "one \ue000 two \ue000b three\nĐiều 1. four\ue000a\nĐiều 2. five"
    row = spark.createDataFrame([(text,)], "t string").select(chunking.marked_pieces(F.col("t"), chunking.ARTICLE).alias("p")).first()
    assert row["p"] == ["one \ue000 two \ue000b three\n", "Điều 1. four\ue000a\n", "Điều 2. five"]


def test_encoding_across_batches(spark):
    def call(texts):
        assert [len(t.split()) for t in texts] == sorted((len(t.split()) for t in texts), reverse=True) and len(texts) <= 64
        return [[float(len(t.split())), 3.0, 4.0] for t in texts]

    rows = [(i, " ".join(["w"] * (i % 40))) for i in range(300)] + [(300, None)]
    df = values(spark, rows, "chunk_idx long, text string").coalesce(1)
    got = {r["chunk_idx"]: r for r in encoding.encode(df, call, most=30, batch=15, super_batch=250).collect()}
    assert len(got) == 301 and all(got[i]["n_tokens"] == i % 40 and got[i]["vec"][0] == min(30, i % 40) and got[i]["truncated"] == (i % 40 > 30) for i in range(300)) and got[300]["vec"][0] == 0
    short = encoding.encode(df, call, dim=2).where("chunk_idx = 4").first()["vec"]
    assert short == pytest.approx([0.8, 0.6])
    row = encoding.length_statistics(encoding.encode(df, call, most=30)).first()
    assert (row["n_texts"], row["longest"], round(row["truncated"], 6)) == (301, 39, round(sum(i % 40 > 30 for i in range(300)) / 301, 6))


def test_vectors_are_encoded_once(spark, tmp_path):
    path, rows = str(tmp_path / "vectors"), values(spark, [(i, f"text {i}") for i in range(30)], "chunk_idx long, text string")
    coded = lambda df: encoding.encode(df, encoding.hashed_encoder(8))
    parts = []
    assert encoding.build_vectors(rows.where("chunk_idx < 9"), path, coded, part_rows=4).count() == 9
    found = encoding.build_vectors(rows, path, lambda df: (parts.append(df.count()), coded(df))[1], part_rows=100)
    assert parts == [21] and found.count() == 30
    whole = {r["chunk_idx"]: r["vec"] for r in coded(rows).collect()}
    assert {r["chunk_idx"]: r["vec"] for r in found.collect()} == whole


def test_pairs_are_cut_together(spark):
    pairs = values(spark, [(1, "a b c", "x " * 9 + "a"), (2, "a b c", "a c " + "x " * 9), (3, None, "a"), (4, "a", None)], "qid long, question string, text string")
    got = {r["qid"]: (round(r["logit"], 6), r["n_tokens"]) for r in encoding.score_pairs(pairs, encoding.overlap, most=8).collect()}
    assert got == {1: (0.0, 13), 2: (round(2 / 3, 6), 14), 3: (0.0, 1), 4: (0.0, 1)}


def test_search_requests(spark, idx):
    chunks = values(spark, [(i, d, f"t{i} > p\nbody {t}", f"p{i}", 3, 3) for i, d, t in CORPUS], "chunk_idx long, doc_id long, text string, path string, n_words int, tier int")
    asked = values(spark, [(1, "phí căn cước zzz", 0, None, "max"), (2, "phí căn cước", 500, "chunk", None), (3, "", 5, None, None), (4, None, None, None, None), (5, "phí căn cước", None, "doc", "none such"), (6, "zzz", -3, None, None)], "qid long, q string, k int, mode string, agg string")
    got = {r["qid"]: (r["terms"], [(x["doc_id"], x["score"]) for x in r["results"]]) for r in search.search(idx, chunks, asked).collect()}
    assert got[1] == (["phí", "căn", "cước"], [(10, 3.28)]) and got[2][1] == [(10, 3.28), (10, 1.82), (20, 1.1)]
    assert got[3] == got[4] == got[6] == ([], []) and got[5][1] == [(10, 2.55), (20, 1.1)]


def test_document_requests(spark):
    docs = values(spark, [(7, "n", None, "text")], "doc_id long, name string, link string, passage string")
    asked = values(spark, [("7",), ("8",), ("7x",), ("",), (None,)], "doc_id string")
    got = {r["doc_id"]: (r["found"], r["error"], r["html"] is not None) for r in search.documents(asked, docs).collect()}
    assert got == {"7": (True, None, True), "8": (False, "unknown", False), "7x": (False, "invalid", False), "": (False, "invalid", False), None: (False, "invalid", False)}


def shown(df):
    return sorted((*r[:-1], round(r[-1], 9)) for r in df.select(*[c for c in df.columns if c != "score"], "score").collect())


@pytest.mark.parametrize(("k", "block"), [(1, 8000), (7, 6), (200, 8000)])
def test_best_chunks_are_the_first_of_all(spark, monkeypatch, k, block):
    """Copies make ties; blocks of a few questions and steps of a few chunks give the same rows."""
    monkeypatch.setattr(matching, "BLOCK", block)
    monkeypatch.setattr(matching, "STEP", 7)
    rows = [(i << 20, i, " ".join(f"w{(i * j) % 23}" for j in range(1, 2 + i % 9))) for i in range(150)] + [(1000 + i << 20, 1000 + i, "w1 w2 w3") for i in range(30)]
    idx = index.build(values(spark, rows, "chunk_idx long, doc_id long, text string").repartition(5))
    asked = values(spark, [(i, f"w{i} w{i + 1} w{2 * i} w{i}") for i in range(9)] + [(20, "none"), (21, None)], "qid long, question string")
    params = values(spark, [(0.6, 0.4), (2.0, 0.9)], "k1 double, b double")
    assert shown(scoring.best_chunks(idx, asked, k)) == shown(scoring.top_chunks(scoring.score(idx, asked), k))
    by = ["k1", "b"]
    assert shown(scoring.top_chunks(scoring.score(idx, asked, params, k=k), k, by)) == shown(scoring.top_chunks(scoring.score(idx, asked, params), k, by))
    assert scoring.best_chunks(idx, asked.where("false"), k).count() == 0


def test_scores_shuffle_no_match(spark, idx):
    asked = values(spark, [(1, "phí căn cước")], "qid long, question string")
    plan = scoring.score(index.Index(idx.postings, idx.vocab, idx.blocks, values(spark, [(0, 10, 1, [("phí", 1)])], "chunk_idx long, doc_id long, doclen int, terms array<struct<term: string, tf: int>>"), idx.corpus_stats), asked)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_index_of_queries_has_no_postings(spark, tmp_path):
    spark.createDataFrame([(1, "s", "alpha beta"), (2, "s", "beta gamma delta")], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert retrieval.corpus_index(spark, str(tmp_path)).buckets == 0 and retrieval.corpus_postings(spark, str(tmp_path)).buckets > 0


def test_upper_case_by_letter(spark):
    assert values(spark, [("Erßie đ",), (None,)], "t string").select(T.upper("t")).collect()[0][0] == "ERßIE Đ"


def test_cached_terms_keep_their_line_ends(spark, tmp_path):
    rows = [(1, 0, "user", "one.\ntwo three")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert len(rows[0][3]) % 3  # the stand-in answers
    assert queries.QUERIES["expansion_cache"](spark, str(tmp_path)).first()["terms"] == "alpha beta|one.\ntwo"


def test_packed_terms_are_those_of_the_pattern(spark):
    texts = ["", " \n", "a A b\x00b _x 9", "Phần 1 > Điều 2: ÀÉ ﬁ Straße", "ΑΣ ΑΣ'Α İx", "日本語 𝒜𝒷 x²½ ٣٤ é", "\U0001F600 no🙂pe", "z y z " * 300]
    chunks = values(spark, [(i, 10 * i, t) for i, t in enumerate(texts)], "chunk_idx long, doc_id long, text string").repartition(1)
    wanted = {r["chunk_idx"]: Counter(r["t"]) for r in chunks.select("chunk_idx", T.tokens("text").alias("t")).collect()}
    got = {r["chunk_idx"]: r for r in index.packed(chunks).collect()}
    assert {i: sum(c.values()) for i, c in wanted.items()} == {i: r["doclen"] for i, r in got.items()}
    assert {i: sorted(c.items()) for i, c in wanted.items()} == {i: sorted(zip(r["terms"].split(" ") if r["terms"] else [], r["tfs"], strict=True)) for i, r in got.items()}
    df = Counter(t for c in wanted.values() for t in c)
    assert dict(index.packed_frequencies(index.packed(chunks)).collect()) == df
    assert dict(index.document_frequencies(index.listed(index.forward(chunks))).collect()) == df


def test_space_is_that_of_the_pattern(spark):
    signs = [chr(i) for i in [*range(1, 0x3001), 0xFEFF] if not 0xD800 <= i < 0xE000]
    got = values(spark, [(x,) for x in signs], "x string").select("x", T.strip(F.concat("x", F.lit("a "), "x")).alias("s"), T.n_words("x").alias("n"), F.col("x").rlike(f"^{T.SPACE}$").alias("space")).collect()
    assert all((r["s"] == "a", r["n"] == 0) == (r["space"], r["space"]) for r in got)
    texts = ["a  b", "a\tb \t c", "a\r\n\r\nb", "\n\na b\n\n\nc ", "a b\nc"]
    cleaned = [r[0] for r in values(spark, [(t,) for t in texts], "t string").select(T.clean("t")).collect()]
    assert cleaned == ["a b", "a b c", "a\nb", "a b\nc", "a b\nc"]


def test_few_best_are_found_in_one_pass(spark, monkeypatch):
    """A search for a few reads the rows once, without the pass that tells marks, and ranks as the search of all does."""
    chunks = values(spark, [(i, i // 3, " ".join(f"w{j}" for j in range(i % 7, 12) if (i * j) % 5)) for i in range(200)], "chunk_idx long, doc_id long, text string")
    idx, asked = index.build(chunks), values(spark, [(1, "w2 w3 w9"), (2, "w1 w11 w4 w4")], "qid long, question string")
    every = [tuple(r) for r in scoring.top_chunks(scoring.score(idx, asked), 7).select("qid", "chunk_idx", "rnk").orderBy("qid", "rnk").collect()]
    monkeypatch.setattr(matching, "STEP", 20)
    monkeypatch.setattr(matching, "_least_of", None)
    assert every == [tuple(r) for r in scoring.top_chunks(scoring.score(idx, asked, k=7), 7).select("qid", "chunk_idx", "rnk").orderBy("qid", "rnk").collect()]


def test_bounded_search_needs_no_postings(spark, tmp_path):
    """Its tasks read the rows as they lie: no match and no posting is shuffled, and steps of chunks are its blocks."""
    chunks = values(spark, [(i, i, " ".join(f"w{j}" for j in range(i % 7, 12) if (i * j) % 5)) for i in range(200)], "chunk_idx long, doc_id long, text string")
    index.write_rows(index.packed(chunks), str(tmp_path))
    index.write_terms(spark, str(tmp_path))
    idx, asked = index.read_terms(spark, str(tmp_path)), values(spark, [(1, "w2 w3 w9"), (2, "w1 w11 w4 w4")], "qid long, question string")
    idx.postings = idx.blocks = None
    found = scoring.bounded_top_chunks(idx, asked, 5)
    shown = lambda df: [(r["qid"], r["rnk"], r["chunk_idx"], round(r["score"], 9)) for r in df.orderBy("qid", "rnk").collect()]
    assert shown(found.top) == shown(scoring.top_chunks(scoring.score(idx, asked), 5))
    assert {r["stage"]: r["scored"] for r in scoring.bounded_top_chunks(idx, asked.where("false"), 5).tally.collect()} == {"matched": 0, "seeds": 0}


def test_texts_meet_passages_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "stored", lambda df, name: df)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieval.gold(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("tf", [[1, 2, 1], [1, 9, 3]])
def test_scores_of_many_pairs_are_those_of_each(monkeypatch, tf):
    """Weights of few frequencies are summed once: a pair counts again at most what is left."""
    import numpy as np
    import pyarrow as pa

    looked = matching.Weights.of(pa.table({"qid": [7, 7, 8, 8], "term": ["a", "b", "b", "c"], "w": [1.0, 0.5, 2.0, 0.25]}), [7, 8])
    chunks = pa.RecordBatch.from_arrays([pa.array([40, 3], pa.int32()), pa.array(["a b c", "a"]), pa.array([tf, [2]], pa.list_(pa.int32()))], ["doclen", "terms", "tfs"])
    pairs = [(k1, b) for k1 in (0.6, 1.2, 2.0) for b in (0.4, 0.9)]
    each = [next(looked.sums(chunks, 2, [p], 20.0)) for p in pairs]
    counted, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a: counted.append(len(x)) or plain(x, *a))
    found = list(looked.sums(chunks, 2, pairs, 20.0))
    assert np.allclose(found, each, rtol=0, atol=1e-12) and ((np.array(found) > 0) == (np.array(each) > 0)).all()
    assert sum(counted) < 5 * len(pairs)
