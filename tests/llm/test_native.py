"""Mixing, fingerprints and the similarity join against brute force."""

import hashlib
import math
import random
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import components, fingerprints, mixing, ngram_join
from corvane.llm import queries_native as N
from tests.llm.sql import compare

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def water_filled(sizes):
    """Targets by resharing the excess until no source is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left, free = left - sum(3 * sizes[s] for s in full), free - full
    return target


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    sizes, taken, got, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    for r in rows:
        assert r["size"] == words[r["doc_id"]] and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        got[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    expected = water_filled(sizes)
    for s, t in expected.items():
        assert got[s] == pytest.approx(t) and abs(taken[s] - t) <= largest[s]
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_rates_solve_the_dual(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("source = 'src1' or source = 'src2'")
    rows = mixing.mix(docs).collect()
    for source in ("src1", "src2"):
        own = [r for r in rows if r["source"] == source]
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=1e-5)
        m = {round(math.log(r["rate"]) / r["size"], 12) for r in own if r["size"] and 0 < r["rate"] < 3}
        assert max(m) - min(m) < 1e-9


def test_mix_of_odd_tables(spark):
    rows = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (4, "x " * 500, "en", "é", 1000), (None, "w", "en", "", 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", size int")
    got = mixing.mix(docs).collect()
    assert len(got) == 6 and all(r["taken"] <= 3 * r["size"] for r in got)
    sizes = {None: 0, "a": 4, "é": 500, "": 1}
    expected = water_filled(sizes)
    assert all(r["target"] == pytest.approx(expected[r["source"]]) for r in got)
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns and mixing.apply_mix(docs.where("false")).count() == 0


def folded(text):
    x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", x).strip(" ")


def test_fingerprints_group_canonical_texts(spark):
    texts = ["Straße  eins", "STRASSE eins ", "ﬁn", "FIN", "é", "é", "É", "", None, " \n", "a b", "A b", "other"]
    rows = fingerprints.fingerprint(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")).collect()
    groups, brute = defaultdict(set), defaultdict(set)
    for r in rows:
        groups[r["fingerprint"]].add(r["doc_id"])
        brute[folded(r["text"])].add(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.lit("same"))
    rows = fingerprints.fingerprint(spark.createDataFrame([(1, "a"), (2, "b"), (3, "A ")], "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert got[1] == got[3] != got[2]


@pytest.mark.parametrize("range_rows", [1, 3, 1000])
def test_following_document(spark, range_rows):
    ids = [5, 9, -3, 40, 41, 2]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_following(docs, range_rows=range_rows).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(down, [*down[1:], down[0]], strict=True)}


def test_edited_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    down = sorted(texts, reverse=True)
    following = dict(zip(down, [*down[1:], down[0]], strict=True))
    seen = {}
    for r in fingerprints.edited_fingerprints(docs).collect():
        text, after = texts[r["doc_id"]], texts[following[r["doc_id"]]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"], r["near_next"]) == (float(folded(text) == folded(edited)), float(folded(text) == folded(after)))
        assert seen.setdefault(r["fingerprint"], folded(text)) == folded(text)


def test_groups_of_fingerprints(spark):
    rows = [(i if i % 9 else None, "hot" if i % 3 else f"f{i // 4}", str(i % 50)) for i in range(400)]
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint string, edited_sha256 string")
    least = {f: min((d for d, g, _ in rows if g == f and d is not None), default=None) for _, f, _ in rows}
    for most in (1000, 0):
        got = sorted((r["doc_id"] or -1, r["fingerprint"], r["group_id"]) for r in fingerprints._grouped(prints, most).collect())
        assert got == sorted((d or -1, f, least[f]) for d, f, _ in rows)


def test_edited_fingerprints_of_odd_tables(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "😀é", 0), (None, "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    assert fingerprints.edited_fingerprints(docs).count() == 4
    assert fingerprints.edited_fingerprints(docs.where("false")).count() == 0
    only = fingerprints.edited_fingerprints(docs.where("text = 'n'")).first()
    assert only["near_next"] == 1.0


def brute_components(texts, size, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)) if w else frozenset()

    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        shared = defaultdict(int)
        for g in sets[d]:
            for e in holders[g]:
                shared[e] += 1
            holders[g].append(d)
        for e, o in shared.items():
            if 100 * o >= percent * (len(sets[d]) + len(sets[e]) - o):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_components_against_all_pairs(spark, size, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs, size, percent).collect()}
    assert got == brute_components(texts, size, percent)


def test_families_of_near_copies_in_blocks(spark, monkeypatch):
    """A family larger than a block, with links that only the second round finds, and one key in most sets."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(40):  # each differs a little more from the first one
        w = base.copy()
        for k in range(0, i, 2):
            w[(k * 3) % 60] = f"x{i}_{k}"
        texts[i] = " ".join(w)
    for i in range(40, 55):
        texts[i] = "the same words again and again in each of them " + " ".join(f"y{i}_{k}" for k in range(3))
    texts |= {60: None, 61: "", 62: " \t", 63: "a b", 64: "A  B", 65: "a"}
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, h int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs, 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)


def test_join_of_odd_tables(spark):
    docs = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (3, "other words are in here now"), (1, "A b c d  e"), (None, "a b c d e")], "doc_id long, text string")
    got = ngram_join.similar_components(docs, 4, 85).collect()
    assert len(got) == 5 and {r["component_id"] for r in got if r["doc_id"] is not None} == {1}
    assert ngram_join.similar_components(docs.where("false"), 4, 85).count() == 0
    kept = ngram_join.one_of_each(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (4, None)], "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4]


def test_join_of_repeated_ids(spark):
    """A doc_id with several texts has the links of all of them, and links their families."""
    a, b = "one two three four five six seven eight", "red blue green white black grey brown pink"
    docs = spark.createDataFrame([(5, a, 0), (5, b, 0), (5, None, 0), (5, a, 1), (7, a + " ", 0), (9, b.upper(), 0), (11, "x y", 0), (12, None, 0)], "doc_id long, text string, comp int")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.similar_components(docs, 4, 85).collect()}
    assert got == {(5, 5): 5, (5, 0): 5, (7, 5): 5, (9, 5): 5, (11, 1): 11, (12, 0): 12}
    kept = ngram_join.one_of_each(docs, 4, 85).collect()
    assert sorted(r["doc_id"] for r in kept) == [5, 11, 12] and kept[0].asDict().keys() == {"doc_id", "text", "comp"}


def test_near_copies_with_columns_that_have_no_order(spark):
    docs = spark.sql("""SELECT doc_id, text, map('k', n) AS m, parse_json(concat('[', n, ']')) AS v, n FROM VALUES
      (1, 'a b c d e f', 1), (2, 'A b c d e f', 2), (3, 'other words here and there', 3), (3, 'other words here and there', 4), (3, 'zzz', 5), (4, NULL, 6) AS t(doc_id, text, n)""").withColumn("doc_id", F.col("doc_id").cast("long"))
    kept = ngram_join.one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    rows = sorted((r["doc_id"], r["text"], r["m"]["k"]) for r in kept.select("doc_id", "text", "m").collect())
    assert [r[:2] for r in rows] == [(1, "a b c d e f"), (3, "other words here and there"), (4, None)] and rows[1][2] in (3, 4)
    assert rows == sorted((r["doc_id"], r["text"], r["m"]["k"]) for r in ngram_join.one_of_each(docs.repartition(7)).select("doc_id", "text", "m").collect())


def test_every_link_of_random_families(spark, monkeypatch):
    """Random edits of a few texts, in parts of three rows, so that groups are dealt and parts are crossed."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "FIRST", 1)
    rng = random.Random(5)
    texts = {}
    for i in range(160):
        w = [f"f{i % 5}_{k}" for k in range(50)]
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            w[rng.randrange(50)] = f"e{rng.randrange(4)}"
        texts[i * 3 + 1] = " ".join(w)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs, 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)


def test_unfinished_components_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(links, rounds=1)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (5, 5), (None, 2), (900, 100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 900: 100, 7: 3}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["mixing_targets", "edited_digests"])
def test_native_queries_like_their_sql(spark, name):
    compare(spark, N, name)


def test_source_targets_of_odd_tables(spark):
    words = "w " * 30
    docs = spark.createDataFrame([("a", words), ("a", words * 9), ("b", None), ("b", "one"), (None, words), ("", "")], "source string, text string")
    got = {r["source"]: r for r in mixing.source_targets(docs).collect()}
    assert {s: r["n_docs"] for s, r in got.items()} == {"a": 2, "b": 2, None: 1, "": 1} and got[""]["target"] == 0
    assert got["b"]["target"] == 3 and sum(r["target"] for r in got.values()) == sum(r["source_size"] for r in got.values()) == 331
    mixed = {r["source"]: (r["source_size"], r["target"]) for r in mixing.mix(docs.withColumn("doc_id", F.monotonically_increasing_id())).collect()}
    assert mixed == {s: (r["source_size"], r["target"]) for s, r in got.items()} and mixing.source_targets(docs.where("false")).count() == 0
