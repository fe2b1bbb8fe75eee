"""Every stage of the pipeline on odd tables, and the whole pipeline against plain Python on a small table."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tiktoken.load
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import mixing, quality, toxicity
from tests.llm.test_native import brute_components

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, source string, score string, score_ string, features string, size string, copies_ int, copy_ int, component string, c int, row string, key string"


def odd(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "word " * 60_000, "a"), (3, "word " * 60_000, "a"), (4, "idiot " * 50, "b"), (5, "one two three four five six seven", None), (6, "One two three four five six seven", "b"), (None, "no id at all", "b")]
    return spark.createDataFrame([(*r, "s", "t", "f", "z", 7, 8, "p", 9, "r", "k") for r in rows], CLASHING)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_tables(spark, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], odd(spark)
    got = stage(spark, docs, SF)
    rows = got.collect()
    if name == "encoding":
        assert len(rows) == 8 and sum(r["n_tokens"] == 0 for r in rows) == 2
    else:
        assert got.dtypes == docs.dtypes
        assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    if name == "near copies":
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 3, 4, 5]
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    marks = {r["doc_id"]: r for r in labels.collect()}
    sample = [(rows[d]["text"], r["toxic"]) for d, r in sorted(marks.items()) if d in rows and zlib.crc32(str(d).encode()) % 5 != 0]
    model = toxicity.train([t or "" for t, _ in sample], [y for _, y in sample])
    ids = sorted(rows)
    kept = [d for d, s in zip(ids, model.scores([rows[d]["text"] for d in ids]), strict=True) if s < 0.5]
    x = quality.statistics([rows[d]["text"] for d in kept])
    learnt = [(x[i], marks[d]["quality"]) for i, d in enumerate(kept) if d in marks and zlib.crc32(str(d).encode()) % 3 != 1]
    own = [[v for v, y in learnt if y == k] for k in (0, 1)]
    d = x.shape[1]
    fitted = quality.fit_moments([len(o) for o in own], *(np.array(m) for m in zip(*[(sum(o), sum(v[:, None] * v for v in o)) if o else (0 * x[0], 0 * x[0][:, None] * x[0]) for o in own])))
    assert d == len(quality.STATISTICS)
    kept = [d for d, s in zip(kept, fitted.scores(x), strict=True) if s >= 0.5]
    components = brute_components({d: rows[d]["text"] for d in kept}, 5, 80)
    kept = [d for d in kept if components[d][1] == d]
    mixed = mixing.mix(docs.where(F.col("doc_id").isin(kept))).collect()  # tested against plain Python of its own
    expected = Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"]})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == expected
    ranks = tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in got:
        ids = coder.encode_ordinary(rows[r["doc_id"]]["text"] or "")
        assert r["n_tokens"] == len(ids) and bytes(r["token_ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_mix_with_clashing_names(spark):
    docs = odd(spark).where("doc_id is not null")
    taken = Counter(r["doc_id"] for r in mixing.apply_mix(docs).collect())
    expected = Counter()
    for r in mixing.mix(docs.select("doc_id", "text", "source")).collect():
        expected[r["doc_id"]] += r["copies"]
    assert taken == +expected
