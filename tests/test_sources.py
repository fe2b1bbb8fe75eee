"""Readers, submission files, the whole run and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking, expansion, index, scoring, segments
from corvane.plans import retrieval
from corvane.sources import corpus, products, submission
from corvane.streaming import ingest


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for i, text in ((2, "hai"), (10, "mười")):
        (tmp_path / "deep" / f"context_{i}.json").write_text(json.dumps({"id": i, "name": f"n-{i}", "passage": text}), encoding="utf-8-sig" if i == 2 else "utf-8")
    docs = corpus.documents(spark, str(tmp_path))
    assert {r["doc_id"]: r["passage"] for r in docs.collect()} == {"2": "hai", "10": "mười"}
    assert {r["doc_id"] for r in corpus.document_ids(spark, str(tmp_path)).collect()} == {"2", "10"}
    assert [r["doc_id"] for r in corpus.documents(spark, str(tmp_path), limit=1).collect()] == ["10"]


def test_questions(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text(json.dumps({"1": {"question": "a?", "answer": ["5", "6"]}, "2": {"question": "b?", "answer": None}}))
    asked, gold = corpus.questions(spark, str(p))
    assert asked.count() == 2 and [(r["qid"], r["doc_id"], r["pos"]) for r in gold.orderBy("pos").collect()] == [("1", "5", 0), ("1", "6", 1)]
    assert corpus.expansions(spark, None).count() == 0


def test_submission_files(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(submission.pack('{"1":{"answer":["5"]}}'))
    (tmp_path / "b.zip").write_bytes(b"no zip")
    (tmp_path / "c.json").write_text("{}")
    got = {r["sub_id"].rsplit("/", 1)[-1]: ([f["code"] for f in r["file_findings"]], r["json"]) for r in submission.read(spark, str(tmp_path)).collect()}
    assert got["a.zip"] == ([], '{"1":{"answer":["5"]}}') and got["b.zip"] == (["E001"], None) and got["c.json"] == (["W004"], "{}")


DOCS = [(1, "một", None, "phí căn cước"), (2, "hai", None, "thời hạn phí"), (3, "ba", None, "căn cước"), (4, "bốn", None, "thời hạn")]
DDL = "doc_id long, name string, link string, passage string"


def test_expansion_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    asked = spark.createDataFrame([(str(i), f"question {i}") for i in range(40)] + [("7", "question 7")], "qid string, question string")

    def model(questions):
        if any(q.endswith("3") for q in questions):
            raise OSError("out")
        return [f'so: {{"normalized_query": "{q} n", "expansion_terms": ["more {q[-1]}", "in 1999"]}}' if not q.endswith("4") else "{" for q in questions]

    expand = lambda part: expansion.generated(part, model, "m")
    whole = {r["qid"]: r for r in expansion.build_cache(asked, path, expand, batch_rows=7).collect()}
    assert len(whole) == 40 and whole["5"]["source"] == "m" and whole["5"]["expansion_terms"] == ["more 5"] and whole["5"]["normalized_query"] == "question 5 n"
    assert whole["13"]["source"] == "fallback_rules_after_error: OSError" and whole["14"]["source"] == "fallback_rules_after_error: ValueError" and whole["13"]["normalized_query"] == "question 13"
    # A run that breaks off in its third batch and one that takes it up again.
    other, calls = str(tmp_path / "other"), []

    def broken(part):
        calls.append(part)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return expand(part)

    with pytest.raises(RuntimeError, match="lost"):
        expansion.build_cache(asked, other, broken, batch_rows=7)
    kept = corpus.cached_expansions(spark, other).count()
    assert 0 < kept < 40
    resumed = {r["qid"]: r for r in expansion.build_cache(asked, other, expand, batch_rows=7).collect()}
    assert {q: r[:5] for q, r in resumed.items()} == {q: r[:5] for q, r in whole.items()}
    corpus.append_expansions(spark.createDataFrame([("5", "q", "n", ["t"], "later")], "qid string, question string, normalized_query string, expansion_terms array<string>, source string"), path, 99)
    again = corpus.cached_expansions(spark, path)
    assert again.count() == 40 and again.where("qid = '5'").first()["source"] == "m"
    corpus.write_expansions(again, str(tmp_path / "one"))
    back = {r["qid"]: (r["normalized_query"], r["expansion_terms"], r["source"]) for r in corpus.expansions(spark, str(tmp_path / "one")).collect()}
    assert back == {q: (r["normalized_query"], r["expansion_terms"], r["source"]) for q, r in whole.items()}
    assert corpus.cached_expansions(spark, str(tmp_path / "none")).count() == 0


def test_many_batches_of_expansions_take_few_jobs(spark, tmp_path):
    """each batch was a job of its own over all questions."""
    path, asked, parts = str(tmp_path / "cache"), spark.createDataFrame([(i, f"question {i}") for i in range(200)], "qid long, question string"), []

    def expand(part):
        parts.append(part.count())
        return expansion.expand_rules(part)

    made = expansion.build_cache(asked.where("qid < 150"), path, expand, batch_rows=3)
    rows = made.collect()
    assert len(parts) == 8 and sum(parts) == 150 and sorted(int(r["qid"]) for r in rows) == list(range(150))
    assert len({r["batch"] for r in rows}) > 30 and len(list((tmp_path / "cache").glob("batch=*/*.parquet"))) == len({r["batch"] for r in rows})
    whole = expansion.build_cache(asked, path, expand, batch_rows=10).collect()
    assert sum(parts) == 200 and {repr(r) for r in rows} < {repr(r) for r in whole} and len(whole) == 200
    assert {r["batch"] for r in whole if int(r["qid"]) >= 150}.isdisjoint({r["batch"] for r in rows})


def test_run_reuses_products(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, DDL)
    asked = spark.createDataFrame([(1, "căn cước")], "qid long, question string")
    known = spark.createDataFrame([(4, 0)], "doc_id long, pos long")
    first = retrieval.run(docs, asked, str(tmp_path), known=known).first()["answer"]
    assert set(first[:2]) == {"1", "3"} and first[2] == "4"
    folders = sorted(p.name for p in tmp_path.iterdir())
    times = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert retrieval.run(docs.repartition(3), asked, str(tmp_path), known=known).first()["answer"] == first
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == times
    # Other documents make other products.
    assert retrieval.run(docs.where("false"), asked, str(tmp_path), known=known).first()["answer"] == ["4"]
    assert retrieval.run(docs.where("doc_id <> 3"), asked, str(tmp_path), known=known).first()["answer"] == ["4"]
    assert len(list(tmp_path.iterdir())) > len(folders)
    retrieval.run(docs, asked, str(tmp_path), force=True).count()
    assert not set(times) & set(tmp_path.rglob("*.parquet")) or any(p.stat().st_mtime_ns != t for p, t in times.items() if p.exists())


def test_run_with_expansions_and_reranker(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, DDL)
    asked = spark.createDataFrame([(1, "cước"), (2, "hạn")], "qid long, question string")
    expansions = spark.createDataFrame([(1, "cước", ["thời hạn"])], "qid long, normalized_query string, expansion_terms array<string>")
    answers = lambda **k: {r["qid"]: set(r["answer"]) for r in retrieval.run(docs, asked, str(tmp_path), **k).collect()}
    assert answers() == {1: {"1", "3"}, 2: {"2", "4"}}
    assert answers(expansions=expansions) == {1: {"1", "2", "3", "4"}, 2: {"2", "4"}}
    assert answers(expansions=expansions, options=retrieval.Options(combine="off")) == answers()
    overlap = lambda pairs: pairs.withColumn("logit", F.when(F.contains("text", F.lit("phí")), 1.0).otherwise(0.0))
    got = {r["qid"]: r["answer"] for r in retrieval.run(docs, asked, str(tmp_path), rerank=overlap, options=retrieval.Options(beta=1.0)).collect()}
    assert got == {1: ["1", "3"], 2: ["2", "4"]}
    idx = index.build(chunking.with_index(chunking.chunk(docs)))
    plain, longer = scoring.score(idx, asked), scoring.score(idx, expansion.expanded_queries(asked, expansions))
    for mode in ("max", "interpolate", "expanded"):
        o = retrieval.Options(combine=mode)
        one = {(r["qid"], r["chunk_idx"]): round(r["score"], 9) for r in retrieval.lexical_scores(idx, asked, o, expansions).collect()}
        assert one == {(r["qid"], r["chunk_idx"]): round(r["score"], 9) for r in expansion.combine(plain, longer, mode, o.weight).collect()}


def test_products_follow_their_parts(spark, tmp_path):
    made = lambda x, force=False: products.Products(spark, str(tmp_path / "root"), force).get("n", {"x": x}, lambda at: spark.range(x).write.mode("overwrite").parquet(f"{at}/t"))
    one = made(3)
    assert spark.read.parquet(f"{one}/t").count() == 3 and made(3) == one != made(4)
    store = products.Products(spark, str(tmp_path / "root"))
    assert store.manifest(one) == {"name": "n", "parts": {"x": 3}}
    (tmp_path / "root" / one.rsplit("/", 1)[1] / "_manifest" / "_SUCCESS").unlink()  # interrupted before its end
    seen = []
    store.get("n", {"x": 3}, lambda at: (seen.append(at), spark.range(3).write.mode("overwrite").parquet(f"{at}/t")))
    assert seen == [one] and store.made == ["n"]
    other = made(4)
    assert store.clean([one]) == [other.rsplit("/", 1)[1]]
    assert spark.read.parquet(f"{one}/t").count() == 3


def test_content_digest(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "a int, b string")
    assert products.content_digest(df) == products.content_digest(df.orderBy(F.desc("a")))
    assert len({products.content_digest(x) for x in (df, df.where("a = 1"), df.unionByName(df), df.withColumnRenamed("b", "c"), df.where("false"))}) == 5


def test_stream_appends_once(spark, tmp_path):
    schema = "doc_id long, name string, link string, passage string"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i in (1, 2):
        spark.createDataFrame([(i, "n", None, "một hai ba")], schema).write.mode("append").parquet(source)
        ingest.follow(spark, source, schema, out, state).awaitTermination()
    assert spark.read.parquet(f"{out}/chunks").count() == 2
    assert spark.read.parquet(f"{out}/frequencies").where(F.col("term") == "một").count() == 2
    assert {r["term"]: r["df"] for r in segments.merged(spark, f"{out}/index").vocab.collect()} == {}  # in all chunks


def content(idx):
    rounded = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
    return [rounded(idx.postings.select("term", "chunk_idx", "doc_id", "doclen", "tf")), *[rounded(t) for t in (idx.vocab, idx.blocks, idx.chunk_stats, idx.corpus_stats)]]


def test_segments_equal_one_build(spark, tmp_path):
    rnd = random.Random(1)
    passage = lambda: " ".join(rnd.choice("aa bb cc dd ee ff gg hh ii jj kk ll".split()) for _ in range(rnd.randrange(1, 400)))
    frame = lambda rows: spark.createDataFrame([(i, f"n{i}", None, t) for i, t in rows.items()], DDL)
    chunked = lambda docs: chunking.with_index(chunking.chunk(docs))
    state, path = {}, str(tmp_path / "index")
    for number, ids in enumerate(([1, 2, 3, 4], [2, 5], [], [5, 6, 1])):
        batch = {i: (" " if (number, i) == (3, 1) else passage()) for i in ids}
        batch = frame(batch).withColumn("name", F.when(F.col("passage") != " ", F.col("name"))) if ids else frame({0: ""}).where("false")
        for _ in range(1 + (number == 1)):  # a repeated batch
            segments.append(chunked(batch), path, number, batch.select("doc_id"))
        state.update({r["doc_id"]: r for r in batch.collect()})
    every = spark.createDataFrame([tuple(r) for r in state.values()], DDL)
    assert content(segments.merged(spark, path)) == content(index.build(chunked(every)))
    assert content(segments.merged(spark, path, upto=0)) != content(segments.merged(spark, path))
    assert content(segments.compact(spark, path, str(tmp_path / "compact"))) == content(segments.merged(spark, path))


def test_written_index_is_split_and_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PART_DOCS", 4)
    rows = [(d << 20, d, f"hot w{d % 7} w{d % 5}" if d % 10 else "cold w1") for d in range(200)]
    built = index.build(spark.createDataFrame(rows, "chunk_idx long, doc_id long, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dealt = index.dealt(built, 4, part_rows=20).withColumn("task", F.spark_partition_id())
    assert dealt.where("term = 'cold'").select("task").distinct().count() == 1
    parts = dealt.where("term = 'w1'").groupBy("task").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < dealt.where("term = 'w1'").count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    path = str(tmp_path / "index")
    index.write(built, path, buckets=16, part_rows=20)
    read = index.read(spark, path)
    assert content(read) == content(built)
    few = read.postings_of(spark.createDataFrame([("cold",)], "term string"))
    assert few.select("bucket").distinct().count() == 1 and few.where("term = 'cold'").count() == 20
    assert "PartitionFilters: [bucket" in few._jdf.queryExecution().toString() or "bucket#" in few._jdf.queryExecution().toString().split("PartitionFilters")[1][:60]


@pytest.mark.parametrize("k", [1, 10, 60])
def test_bounded_search_equals_all_scores(spark, tmp_path, k):
    rnd = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    rows = [(d << 20, d, " ".join(rnd.choices(words, odds, k=rnd.randrange(0, 90)))) for d in range(500)]
    rows += [(9000 + i << 20, 9000 + i, rows[5][2]) for i in range(8)]  # ties
    idx = index.build(spark.createDataFrame(rows, "chunk_idx long, doc_id long, text string"))
    index.write(idx, str(tmp_path / "index"))
    idx = index.read(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(i, " ".join(rnd.choices(words, odds, k=9)) + f" w{200 + i}") for i in range(6)] + [(7, ""), (8, "none such"), (9, rows[5][2])], "qid long, question string")
    shown = lambda df: sorted((r["qid"], r["rnk"], r["chunk_idx"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    found = scoring.bounded_top_chunks(idx, asked, k)
    assert shown(found.top) == shown(scoring.top_chunks(scoring.score(idx, asked), k))
    tally = {r["stage"]: r["scored"] for r in found.tally.collect()}
    assert tally["matched"] == idx.postings.join(scoring.query_terms(asked), "term").count()
    assert k > 1 or sum(n for s, n in tally.items() if s != "matched") < tally["matched"]
    assert scoring.bounded_top_chunks(idx, asked.where("false"), k).top.count() == 0
