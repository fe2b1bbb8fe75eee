"""Classifiers by held-out accuracy, telephony by its rules, WARC by parsing back."""

import gzip
import hashlib
import json
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from corvane.llm import quality, telephony, toxicity, warc
from corvane.llm import queries_documents as Q
from corvane.llm import queries_pages as W

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores))
    pos = labels == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


@pytest.mark.parametrize(("query", "label", "least"), [(Q.op2_quality, "quality", 0.99), (Q.op5_toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    scored = query(spark, SF)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = scored.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", "predicted", label).toPandas()
    assert (rows["predicted"] == rows[label]).mean() >= least
    assert ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()


@pytest.mark.parametrize(("modulus", "remainder"), [(3, 1), (5, 0)])
def test_held_out_rows(spark, modulus, remainder):
    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", Q.held_out(modulus, remainder)).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder) for r in rows)


def tiny(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, score string, features string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("labels", [[], [(1, None, None), (None, 1, 1)], [(1, 1, 0), (2, 0, 1), (2, 0, 1)]])
def test_classifiers_on_odd_tables(spark, tmp_path, labels):
    d = tiny(spark, tmp_path, [(1, None, "a", None), (2, "", None, "b"), (None, "w " * 40_000, None, None), (4, "x" * 20_000, None, None), (4, "x" * 20_000, None, None)], labels)
    for query in (Q.op2_quality, Q.op5_toxicity):
        rows = query(spark, d).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    d = tiny(spark, tmp_path / "none", [], labels)
    assert Q.op2_quality(spark, d).count() == Q.op5_toxicity(spark, d).count() == 0


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    x = [rng.normal(size=(400, d)), rng.normal(1, 2, size=(300, d))]
    m = quality.fit_moments([400, 300], np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), pool=0, sphere=0, sharpness=1)
    every = np.concatenate(x)
    logs = []
    for a in x:
        z = np.clip((every - m.centre) / m.scale, -quality.BOUND, quality.BOUND)
        own = (a - m.centre) / m.scale
        cov = np.cov(own.T, bias=True)
        gap = z - own.mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) + np.linalg.slogdet(cov)[1]))
    expected = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + np.log(301 / 401), -500, 500)))
    assert np.allclose(m.scores(every), expected, atol=1e-4)


def test_toxic_windows():
    assert toxicity.windows(None) == toxicity.windows(" \n") == []
    assert [len(w) for w in toxicity.windows("a" * 150)] == [64, 64, 22]
    assert toxicity.train(["a b"], [0]).scores(["x", None]).tolist() == [0, 0]


def test_companding_tables():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA], a[0]) == (-8, 8, -32256, 32256, -5504)
    assert sorted(set(np.abs(mu.astype(int)))) == sorted(set(mu[mu >= 0].astype(int))) and len(set(a.tolist())) == 256


def plain_ima(block):
    value, index = int(np.frombuffer(block[:2], "<i2")[0]), min(block[2], 88)
    out, steps = [value], telephony.ima_steps().tolist()
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = steps[index]
            gap = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - gap if code & 8 else value + gap))
            index = max(0, min(88, index + telephony.INDEX_MOVES[code & 7]))
            out.append(value)
    return out


def test_adpcm_blocks():
    blocks = np.random.default_rng(1).integers(0, 256, (9, 60)).astype(np.uint8)
    assert telephony.ima_decode(blocks).tolist() == [plain_ima(b.tobytes()) for b in blocks]
    wave = (np.sin(np.arange(4 * 1145) / 9) * 9000).astype(np.int16).reshape(4, 1145)
    assert np.abs(telephony.ima_decode(telephony.ima_encode(wave)).astype(int) - wave).mean() < 100


@pytest.mark.parametrize("tag", [telephony.TAG_MULAW, telephony.TAG_ALAW, telephony.TAG_IMA])
def test_media_round_trip(spark, tag):
    docs = spark.createDataFrame([(1, "héllo"), (2, None), (3, "x" * 5000)], "doc_id long, text string")
    back = telephony.decode(telephony.store(docs, tag=tag)).collect()
    for r in back:
        raw = (r["text"] or "").encode()
        assert bytes(r["payload"])[: len(raw)] == raw and r["n_bytes"] == len(raw) and len(r["payload"]) % 576 == 0
        assert set(bytes(r["payload"])[len(raw) :]) <= {255} and r["pcm_rate"] == 16000
        assert len(r["pcm"]) == 4 * len(telephony.expand(bytes(r["payload"]), tag))


def test_op3(spark, tmp_path):
    texts = [(1, "héllo"), (2, None), (3, ""), (4, "y" * 576), (5, "y" * 577), (5, "y" * 577)]
    spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, feature string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = Q.op3_telephony(spark, str(tmp_path)).collect()
    assert len(rows) == 6
    for r in rows:
        raw = (dict(texts)[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        stored = telephony.wav_build(payload, telephony.TAG_MULAW)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r["feature"] for r in rows}) == 4  # null and empty sound alike


PAGE = '<html><head><title>A &amp; B</title><script>x("</p>")</script></head><body><!-- <a href="/no">no</a> --><p>One&nbsp;two<br>three</p><a class=x href="/rel?a=1&amp;b=2">L</a> <a href=\'http://other/\'>M</a></body></html>'


def test_derived_records():
    made = warc.derive_one(warc.response("http://h/dir/p", PAGE, "1"))
    assert [m["record_type"] for m in made] == ["metadata", "conversion"]
    source = warc.parse(warc.response("http://h/dir/p", PAGE, "1"))[0][0]
    for m in made:
        (headers, block), = warc.parse(m["record"])
        assert warc.first(headers, "warc-refers-to") == warc.first(source, "warc-record-id") == m["refers_to"]
        assert warc.first(headers, "warc-source-payload-digest") == warc.first(source, "warc-payload-digest") == warc.digest(PAGE.encode())
        assert warc.first(headers, "warc-block-digest") == warc.digest(block) == m["block_digest"]
    assert warc.parse(made[1]["record"])[0][1].decode() == "One two\nthree\nL M"
    about = json.loads(warc.parse(made[0]["record"])[0][1])
    assert about["links"] == ["http://h/rel?a=1&b=2", "http://other/"] and about["title"] == "A & B" and about["payload_intact"]
    assert ["WARC-Target-URI", "http://h/dir/p"] in about["source"] and ["Content-Type", "text/html; charset=utf-8"] in about["http"]["headers"]


def test_records_one_after_the_other_and_compressed():
    both = warc.response("http://a/", "x", "1", compressed=True) + warc.response(None, None, "2", compressed=True)
    assert len(warc.parse(both)) == 2 and len(warc.derive_one(both)) == 4
    assert warc.derive_one(warc.build("warcinfo", "<urn:uuid:0>", [], "text/plain", b"hi")) == []
    with pytest.raises(ValueError, match="cut short"):
        warc.parse(warc.response("http://a/", "xyz", "1")[:-8])


def test_scanner_is_linear_and_keeps_what_never_ends():
    from time import process_time

    for part in ("<a ", "<script>", "<!--", "<title>", "</", '<a href="', "<p>" "<style><"):
        page, begin = part * (2_000_000 // len(part)), process_time()
        warc.plain_text(page), warc.title(page), warc.links(page, "http://h/")
        assert process_time() - begin < 20, part
    assert warc.plain_text("a < b <i>c</i> <!-- d <b>e</b>") == "a < b c e"
    assert warc.plain_text("x<script>y<p>z") == "xy\nz" and warc.plain_text("<P CLASS=a>q</p >r<br/>s") == "q\nr\ns"
    assert warc.links("<a>n</a><a HREF = '/x'>1<noscript><a href=y>2<script><a href=z></script><abbr href=w>", "http://h/p/") == ["http://h/x", "http://h/p/y"]
    assert warc.title("<head><title lang=en>A &amp;\n B</title>") == "A & B" and warc.title("<title>no end") is None


def test_files_that_are_no_records_say_why(spark):
    good = warc.response("http://a/", "x", "1")
    rows = [(1, good), (2, good[:-8]), (3, b"\x1f\x8bno gzip"), (4, b"noise"), (5, None)]
    got = {r["n"]: r for r in warc.derivatives(spark.createDataFrame(rows, "n int, record binary")).collect()}
    assert [len(got[n]["derived"]) for n in range(1, 6)] == [2, 0, 0, 0, 0]
    assert [got[n]["error"] is None for n in range(1, 6)] == [True, False, False, False, True]


def http_response(head, body, extra=()):
    block = "\r\n".join(["HTTP/1.1 200 OK", *head]).encode("latin-1") + b"\r\n\r\n" + body
    return warc.build("response", "<urn:uuid:1>", [("WARC-Target-URI", "http://h/"), *extra], "application/http; msgtype=response", block)


def derived(record):
    made, faults = warc.derive(record)
    (_, about), (_, text) = (warc.parse(m["record"])[0] for m in made)
    return json.loads(about), text.decode(), faults


def test_all_source_headers_are_kept():
    about, _, _ = derived(http_response(["Set-Cookie: a=1", "Set-Cookie: b=2", "X-NoSpace:yes", "X-Long: one", "  two"], b"x", [("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>")]))
    assert about["http"]["headers"] == [["Set-Cookie", "a=1"], ["Set-Cookie", "b=2"], ["X-NoSpace", "yes"], ["X-Long", "one two"]]
    assert [v for k, v in about["source"] if k == "WARC-Concurrent-To"] == ["<a>", "<b>"]


def test_charset_and_codings():
    cafe = "<p>caf\xe9 &amp; \u20ac".encode("cp1252")
    assert derived(http_response(["content-type: text/html; charset=iso-8859-1"], "<p>caf\xe9".encode("latin-1")))[1] == "caf\xe9"
    assert derived(http_response(["Content-Type: text/html"], b'<meta charset="windows-1252">' + cafe))[1] == "caf\xe9 & \u20ac"
    assert derived(http_response(["Content-Type: text/html; charset=none-such"], "caf\xe9".encode()))[1] == "caf\xe9"
    for coding, pack in (("gzip", gzip.compress), ("deflate", zlib.compress), ("deflate", lambda x: zlib.compress(x, wbits=-15)), ("zstd", zstandard.compress)):
        about, text, faults = derived(http_response([f"Content-Encoding: {coding}"], pack(b"<p>whole</p>")))
        assert (text, faults, about["payload_intact"]) == ("whole", [], True)
    chunks = b"3;x=y\r\n<p>\r\n5\r\nwhole\r\n0\r\n\r\n"
    assert derived(http_response(["Transfer-Encoding: chunked"], chunks))[1] == "whole"
    about, text, faults = derived(http_response(["Content-Encoding: br"], b"\x0b\x02"))
    assert text == "" and "content coding br" in about["error"] and len(faults) == 1
    assert len(derived(http_response(["Content-Encoding: gzip"], b"no gzip"))[2]) == 1


def test_good_records_around_bad_ones():
    good = [warc.response(f"http://{i}/", "x", str(i)) for i in range(3)]
    made = lambda data: (len(warc.derive(data)[0]) // 2, len(warc.derive(data)[1]))
    assert made(good[0] + b"\r\n" + good[1] + b"\n\n") == (2, 0)  # stray line ends
    assert made(b"".join(good) + b"noise") == (3, 1)
    assert made(good[0] + b"noise\r\n" + good[1]) == (2, 1)
    assert made(good[0] + good[1].replace(b"Content-Length", b"Content-Size", 1).replace(b"Content-Length", b"Content-Size") + good[2]) == (2, 1)
    assert made(good[0] + good[1] + good[2][:-9]) == (2, 1)
    packed = [gzip.compress(g) for g in good]
    assert made(b"".join(packed)) == (3, 0) and made(b"".join(packed) + b"noise") == (3, 1)
    assert made(packed[0] + packed[1] + packed[2][:-9])[0] >= 2 and made(packed[0] + packed[1] + packed[2][:-9])[1] >= 1
    assert made(packed[0] + b"\x1f\x8b" + b"noise" * 9) == (1, 1)


class Shown(HTMLParser):
    """The rules of ``read_page`` on another parser, for pages that are well formed."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out, self.found, self.named, self.in_title = [], [], [], None, False
        self.feed(page)
        self.close()
        self.text = "\n".join(x for x in (" ".join(y.split()) for y in "".join(self.out).split("\n")) if x)

    def handle_starttag(self, tag, attrs):
        if tag in warc.HIDDEN | warc.RAW:
            self.hidden.append(tag)
        self.in_title |= tag == "title"
        if tag in warc.BREAKS and not self.hidden:
            self.out.append("\n")
        if tag == "a" and any(k == "href" for k, _ in attrs):
            self.found.append((dict(attrs)["href"] or "").strip())

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag):]
            self.out.append(" ")
        self.in_title &= tag != "title"
        if tag in warc.BREAKS and not self.hidden:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title and self.named is None:
            self.named = " ".join(data.split())
        if not self.hidden:
            self.out.append(data)

    def handle_comment(self, data):
        self.out.append(" ")


def test_pages_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    same = 0
    for r in pages:
        other = Shown(r["html"] or "")
        text, named, found = warc.read_page(r["html"] or "")
        same += text == other.text
        assert found == other.found and (named or None) == (other.named or None)
    assert same == len(pages)


def test_fit_leaves_out_long_texts_only(spark):
    docs = [(1, "idiot moron stupid " * 9), (2, "calm words of the day " * 9), (3, "z" * 4000), (4, "idiot moron stupid " * 7), (5, "quiet words of the night " * 7)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1), (5, 0)], "doc_id long, toxic int")
    whole, bounded = (toxicity.fit(d, labels, most_bytes=1000) for d in (rows.where("doc_id <> 3"), rows))
    texts = [t for _, t in docs]
    assert bounded.scores(texts) == pytest.approx(whole.scores(texts)) and max(bounded.scores(texts)) > 0
    with pytest.warns(UserWarning, match="every score is 0"):
        assert max(toxicity.fit(rows, labels, most_bytes=10).scores(texts)) == 0


def test_null_features_score_as_empty_texts(spark):
    rows = spark.createDataFrame([(1, "plain words here"), (2, ""), (3, None)], "doc_id long, text string")
    featured = quality.featurise(rows)
    d = len(quality.STATISTICS)
    model = quality.fit_moments([50, 50], np.array([np.ones(d), -np.ones(d)]), np.array([50 * np.eye(d)] * 2))
    nulled = featured.withColumn("features", F.when(F.col("doc_id") < 3, F.col("features")))
    got = {r["doc_id"]: r["score"] for r in quality.score(nulled, model).collect()}
    assert got[2] == got[3] and quality.score(nulled.where("false"), model).count() == 0


def test_pcm_is_stored_and_read_back(spark):
    payload = bytes(range(256)) * 9
    docs = spark.createDataFrame([(1, telephony.wav_build(payload, telephony.TAG_MULAW)), (2, None)], "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in telephony.features(telephony.store_pcm(docs)).collect()}
    tag, rate, _, data = telephony.wav_parse(bytes(rows[1]["pcm_media"]))
    pcm = telephony.resample_double(telephony.mulaw_table()[np.frombuffer(payload, np.uint8)])
    assert (tag, rate, bytes(data)) == (telephony.TAG_PCM, 16000, pcm.tobytes())
    assert rows[1]["pcm_sha256"] == hashlib.sha256(bytes(rows[1]["pcm_media"])).hexdigest()
    assert rows[1]["feature"].endswith(f"pcm16k:{len(pcm)},{zlib.crc32(pcm.tobytes())}") and rows[2]["feature"] is None


def test_stored_pcm_gives_the_same_features(spark, tmp_path):
    docs = spark.createDataFrame([(1, "plain words"), (2, ""), (3, None), (4, "é" * 5000), (5, "plain words")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    once = {r["doc_id"]: r.asDict() for r in telephony.features(telephony.store(docs, keep=["doc_id"]), keep=["doc_id", "n_bytes"]).collect()}
    assert {r["doc_id"]: r.asDict() for r in Q.op3_telephony(spark, str(tmp_path)).collect()} == once and "pcm16k" in once[3]["feature"]
    files = telephony.store_pcm(telephony.store(docs)).withColumn("pcm_bytes", F.lit("x"))
    nulled = files.withColumn("pcm_media", F.when(F.col("doc_id") > 1, F.col("pcm_media")))
    got = {r["doc_id"]: r for r in telephony.pcm_features(nulled).collect()}
    assert got[1]["pcm_feature"] is got[1]["pcm_bytes"] is None and got[2]["pcm_bytes"] == once[2]["pcm_bytes"]
    assert telephony.pcm_features(nulled.where("false")).count() == 0


def test_op6(spark, tmp_path):
    rows = [(1, "http://a/", PAGE), (2, None, None), (2, None, None), (None, "http://b/\r\nX: y", ""), (4, "no url [", "<a href='http://[bad'>x</a>" + "y" * 50_000)]
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record string").write.parquet(str(tmp_path / "pages.parquet"))
    got = W.op6_warc(spark, str(tmp_path))
    assert got.count() == 2 * len(rows) and got.where("record_id = refers_to").count() == 0
    assert got.where(F.col("page_id") == 2).select("record_sha256").distinct().count() == 2
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "e/pages.parquet"))
    assert W.op6_warc(spark, str(tmp_path / "e")).count() == 0
