"""SQL of the queries, for DuckDB over the same tables: common parts first, one entry for each query behind them."""

from __future__ import annotations

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def tokens(c: str) -> str:
    return _TOKENS.format(c)


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(replace({}, chr(13), ''), '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g'), '^\s+|\s+$', '', 'g')"""

CHUNKS = rf"""
cleaned AS (SELECT doc_id, source, {CLEAN.format("text")} AS body FROM documents),
worded AS (SELECT *, list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '') AS w FROM cleaned WHERE body <> ''),
windowed AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= 256 THEN 1 ELSE CAST(ceil((len(w) - 256) / 192.0) AS BIGINT) + 1 END)) AS i FROM worded),
bodied AS (SELECT doc_id, i, source, CASE WHEN len(w) <= 256 THEN body ELSE array_to_string(w[i * 192 + 1 : i * 192 + 256], ' ') END AS body,
  least(len(w), 256, len(w) - i * 192) AS n_words FROM windowed),
chunks AS (SELECT doc_id, i, doc_id * 1048576 + i AS chunk_idx, doc_id || '#' || i AS chunk_id, 'Phần ' || (i + 1) AS path, n_words, body, source,
  source || ' > Phần ' || (i + 1) || chr(10) || body AS text FROM bodied)"""

INDEX = f"""{CHUNKS},
toks AS (SELECT chunk_idx, doc_id, unnest({tokens("text")}) AS term FROM chunks),
tf AS (SELECT chunk_idx, doc_id, term, least(count(*), 65535) AS tf FROM toks GROUP BY ALL),
stats AS (SELECT chunk_idx, doc_id, len({tokens("text")}) AS doclen FROM chunks),
corpus AS (SELECT count(*) AS n_chunks, avg(doclen) AS avgdl FROM stats),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
vocab AS (SELECT term, df, ln(1 + (n_chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM dfs, corpus WHERE df BETWEEN 2 AND floor(n_chunks * 0.7::DOUBLE))"""


def questions(select: str = "SELECT item_id AS qid, text AS question FROM benchmark") -> str:
    return f"asked AS ({select})"


def scores(name: str = "scores", asked: str = "asked", k1: str = "2.5::DOUBLE", b: str = "0.9::DOUBLE", params: str = "") -> str:
    extra, source = (", k1, b", f", {params}") if params else ("", "")
    return f"""{name}_qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens("question")}) AS term FROM {asked}) GROUP BY ALL),
{name} AS (SELECT qid, chunk_idx, s.doc_id{extra}, sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * doclen / avgdl))) AS score
  FROM {name}_qt JOIN vocab USING (term) JOIN tf USING (term) JOIN stats s USING (chunk_idx), corpus{source} GROUP BY ALL)"""


def pool(k: int, name: str = "pool", source: str = "scores", by: str = "") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid{by} ORDER BY round(score, 9) DESC, chunk_idx) AS rnk FROM {source} WHERE score > 0) WHERE rnk <= {k})"""


def docs(agg: str, k: int, name: str = "ranked", source: str = "pool", by: str = "") -> str:
    value = "max(score)" if agg == "max" else "avg(score) FILTER (WHERE r <= 3)"
    by_log = ", per_doc AS (SELECT doc_id, count(*) AS n FROM stats GROUP BY doc_id)" if agg == "top3_log" else ""
    scaled = "score / ln(1 + n::DOUBLE)" if agg == "top3_log" else "score"
    joined = "JOIN per_doc USING (doc_id)" if agg == "top3_log" else ""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY qid{by}, doc_id ORDER BY rnk) AS r FROM {source}){by_log},
{name}_d AS (SELECT qid{by}, doc_id, {value} AS score, min_by(chunk_idx, rnk) AS best_chunk, count(*) AS n_chunk, min(rnk) AS f FROM {name}_r GROUP BY ALL),
{name}_s AS (SELECT qid{by}, doc_id, {scaled} AS score, best_chunk, n_chunk, f FROM {name}_d {joined}),
{name} AS (SELECT * EXCLUDE (f) FROM (SELECT *, row_number() OVER (PARTITION BY qid{by} ORDER BY round(score, 9) DESC, f) AS rnk FROM {name}_s) WHERE rnk <= {k})"""


GOLD = "gold AS (SELECT item_id AS qid, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"

DENSE = """dense AS (SELECT p.*, list_dot_product(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)) AS dense
  FROM pool p CROSS JOIN (SELECT count(*) AS n_vectors FROM embeddings) JOIN embeddings v ON v.vec_id = (p.doc_id * 31 + p.chunk_idx % 1048576) % n_vectors JOIN embeddings q ON q.vec_id = p.qid % n_vectors)"""


def minmax(c: str, per: str = "PARTITION BY qid") -> str:
    return f"CASE WHEN max({c}) OVER ({per}) - min({c}) OVER ({per}) < 1e-9 THEN 0 ELSE ({c} - min({c}) OVER ({per})) / (max({c}) OVER ({per}) - min({c}) OVER ({per})) END"


LINEAR = f"0.7::DOUBLE * {minmax('dense')} + (1 - 0.7::DOUBLE) * {minmax('score')}"
RRF = "1::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_idx)) + 1::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY round(dense, 9) DESC, chunk_idx))"

RANKED = "SELECT qid, doc_id, round(score, 6) AS score, best_chunk, n_chunk, rnk FROM ranked"
BM25 = f"WITH {INDEX}, {questions()}, {scores()}"
POOLED = f"{BM25}, {pool(1000)}, {DENSE}"


def fused(value: str) -> str:
    return f"{POOLED}, fused AS (SELECT *, {value} AS fused FROM dense)"


REFUSED = "fpool AS (SELECT qid, chunk_idx, doc_id, fused AS score, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, chunk_idx) AS rnk FROM fused)"

CANDIDATES = f"""{fused(LINEAR)},
walk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, chunk_idx) AS rn FROM fused),
firsts AS (SELECT *, min(rn) OVER (PARTITION BY qid, doc_id) AS f FROM walk),
nth AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY f) AS nth FROM firsts),
stops AS (SELECT *, min(CASE WHEN nth = 4 THEN rn END) OVER (PARTITION BY qid) AS stop FROM nth),
candidates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rn) AS in_doc FROM stops WHERE stop IS NULL OR rn < stop) WHERE in_doc <= 3)"""


def metrics(ranked: str = "ranked", by: str = "") -> str:
    cross = f", (SELECT DISTINCT {by[2:]} FROM {ranked})" if by else ""
    return f"""wanted AS (SELECT qid, n_gold{by} FROM (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid){cross}),
found AS (SELECT r.qid{by}, count(*) FILTER (WHERE rnk <= 5) AS n_pred, count(*) FILTER (WHERE rnk <= 5 AND g.doc_id IS NOT NULL) AS inter, min(CASE WHEN g.doc_id IS NOT NULL THEN rnk END) AS first
  FROM {ranked} r LEFT JOIN gold g ON g.qid = r.qid AND g.doc_id = r.doc_id GROUP BY ALL),
measured AS (SELECT qid{by}, coalesce(inter, 0)::DOUBLE / n_gold AS recall, CASE WHEN coalesce(n_pred, 0) = 0 THEN 0 ELSE inter::DOUBLE / n_pred END AS precision,
  CASE WHEN coalesce(inter, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit, coalesce(1.0::DOUBLE / CASE WHEN first <= 20 THEN first END, 0) AS rr, first FROM wanted LEFT JOIN found USING (qid{by}))"""


MEANS = "round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS mrr, count(*) AS n_questions"

# Rules of the test: words of the tables stand for the abbreviations and phrases of a domain.
ABBREVIATIONS = (("thth", "the other thing"), ("erst", "first of all"), ("ing", "Thing"))
PHRASES = (("on the|of the", ("on", "of the", "thing")), ("ed.*and", ("Edition", "andante")))

_WORD = r"(^|[^\p{L}\p{N}_])"
_TERM_LISTS = [*[(rf"(?i){_WORD}{a}($|[^\p{{L}}\p{{N}}_])", [t]) for a, t in ABBREVIATIONS], *[(rf"(?i)(?:{p})", ts) for p, ts in PHRASES]]
_RULES = ", ".join(f"({i}, {j}, '{p}', '{t}')" for i, (p, ts) in enumerate(_TERM_LISTS) for j, t in enumerate(ts))
EXPANSIONS = f"""users AS (SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user'),
rules(i, j, pattern, term) AS (VALUES {_RULES}),
hits AS (SELECT qid, i, j, term FROM users, rules WHERE regexp_matches(lower(question), pattern)),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, lower(term) ORDER BY i, j) AS n FROM hits) WHERE n = 1),
listed AS (SELECT qid, list(term ORDER BY i, j)[1:12] AS terms FROM uniq GROUP BY qid),
expanded AS (SELECT u.qid, question, coalesce(terms, []) AS terms, regexp_replace(question || ' ' || array_to_string(coalesce(terms, [])[1:4], ' '), '^\\s+|\\s+$', '', 'g') AS normalized FROM users u LEFT JOIN listed USING (qid))"""

FILTERS = """proposed AS (SELECT item_id AS qid, text AS question, [split_part(text, ' ', 1), 'in 1999', ' ' || split_part(text, ' ', 2) || '  end', upper(split_part(text, ' ', 1)), 'context_5', 'a b c d e f g', ''] AS terms FROM benchmark)"""

VARIANTS = f"{INDEX}, {questions()}, longer AS (SELECT item_id AS qid, text || ' ' || array_to_string(string_split(text, ' ')[1:3], ' ') AS question FROM benchmark), {scores()}, {scores('wide', 'longer')}, both_ AS (SELECT qid, chunk_idx, doc_id, max(o) AS o, max(e) AS e FROM (SELECT qid, chunk_idx, doc_id, score AS o, 0 AS e FROM scores UNION ALL SELECT qid, chunk_idx, doc_id, 0, score FROM wide) GROUP BY ALL)"

REFLOW = r"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS r, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
kept AS (SELECT doc_id, i, s FROM (SELECT doc_id, i, regexp_replace(r, '^\s+|\s+$', '', 'g') AS s FROM raw) WHERE s <> '' AND NOT regexp_full_match(s, '[-_=–—\s.]+')),
lagged AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM kept),
grouped AS (SELECT *, sum(CASE WHEN b IS NULL OR regexp_matches(s, '^(Chương\s+[IVXLCDM\p{Nd}]|Điều\s+\p{Nd}|Mục\s+\p{Nd}|Phần\s+[IVXLCDM\p{Nd}]|\p{Nd}+\.\s|[a-zđ]\)\s|[-+*]\s)') OR regexp_matches(b, '[.;:!?]["'')\]]?$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS line_no FROM lagged),
lines AS (SELECT doc_id, line_no::INT AS line_no, string_agg(s, ' ' ORDER BY i) AS line FROM grouped GROUP BY doc_id, line_no)"""

ESCAPED = """replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""



def _marked(c: str) -> str:
    """Two passes mark neighbours too; a mark's own sign before a word keeps the second from marking twice."""
    return rf"regexp_replace({c}, '(?i)(^|[^\p{{L}}\p{{N}}_>])(there|the|in)($|[^\p{{L}}\p{{N}}_])', '\1<mark>\2</mark>\3', 'g')"


_UNIT = r"""CASE WHEN regexp_matches(line, '^\d+\.\s') THEN 'p class="khoan"' WHEN regexp_matches(line, '^[a-zđ]\)\s') THEN 'p class="diem"' ELSE 'p' END"""

# A submission with one fault of each kind: values by item_id % 12 (none for the last), and entries behind them.
FAULTS = ('{"answer":["1","2"]}', '{"answer":null}', '{"answer":"x"}', "{}", "5", '{"answer":[7]}', '{"answer":[" "]}', '{"answer":["1","1"]}', '{"answer":[]}', '{"answer":["0","1","2","3","4","5"]}', '{"answer":["no such"]}')
ADDED = (("0", '{"answer":["1"]}'), ("new", '{"answer":["1"]}'), ("twice", '{"answer":["1","1","2","2"]}'))

SUBMISSION = f"""faults(r, v) AS (VALUES {", ".join(f"({i}, '{v}')" for i, v in enumerate(FAULTS))}),
listed AS (SELECT item_id::VARCHAR AS qid, v, 0 AS o FROM benchmark JOIN faults ON r = item_id % 12 UNION ALL VALUES {", ".join(f"('{k}', '{v}', 1)" for k, v in ADDED)}),
latest AS (SELECT qid, arg_max(v, o)::JSON AS v FROM listed GROUP BY qid),
typed AS (SELECT qid, json_type(v) AS kind, json_type(v, '$.answer') AS t, json_extract(v, '$.answer') AS a FROM latest),
ids AS (SELECT qid, json_type(e) AS t, json_extract_string(e, '$') AS doc_id FROM (SELECT qid, unnest(json_extract(a, '$[*]')) AS e FROM typed WHERE t = 'ARRAY'))"""

# Titles as the rules have them.
_RULE_TITLES = (("E005", "missing questions"), ("E006", "unexpected questions"), ("E007", "value is no object"), ("E008", "no answer"), ("E009", "answer is no list"), ("E010", "document id is no string"), ("E011", "blank document id"), ("E012", "repeated document id"), ("E013", "repeated question"), ("E014", "unknown document id"), ("W001", "empty answer"), ("W002", "more than five ids"))
FINDINGS = f"""{SUBMISSION}, titles(code, title) AS (VALUES {", ".join(map(str, _RULE_TITLES))}),
broken AS (SELECT 'E007' AS code, qid AS what FROM typed WHERE kind <> 'OBJECT' UNION ALL SELECT 'E008', qid FROM typed WHERE kind = 'OBJECT' AND t IS NULL
  UNION ALL SELECT 'E009', qid FROM typed WHERE kind = 'OBJECT' AND t <> 'ARRAY' UNION ALL SELECT 'W001', qid FROM typed WHERE t = 'ARRAY' AND json_array_length(a) = 0
  UNION ALL SELECT 'W002', qid FROM typed WHERE t = 'ARRAY' AND json_array_length(a) > 5 UNION ALL SELECT 'E010', qid FROM ids WHERE t <> 'VARCHAR'
  UNION ALL SELECT 'E011', qid FROM ids WHERE t = 'VARCHAR' AND trim(doc_id) = '' UNION ALL SELECT DISTINCT 'E012', qid FROM ids WHERE t = 'VARCHAR' GROUP BY qid, doc_id HAVING count(*) > 1
  UNION ALL SELECT 'E013', qid FROM listed GROUP BY qid HAVING count(*) > 1 UNION ALL SELECT 'E014', doc_id FROM ids WHERE t = 'VARCHAR' AND trim(doc_id) <> '' AND doc_id NOT IN (SELECT doc_id::VARCHAR FROM documents)
  UNION ALL SELECT 'E005', item_id::VARCHAR FROM benchmark WHERE item_id::VARCHAR NOT IN (SELECT qid FROM latest) UNION ALL SELECT 'E006', qid FROM latest WHERE qid NOT IN (SELECT item_id::VARCHAR FROM benchmark))"""

POPULAR = "popular AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, f, doc_id) AS place FROM (SELECT doc_id, count(*) AS n, min(qid) AS f FROM gold GROUP BY doc_id) QUALIFY place <= 20)"
PADDED = f"""{BM25}, {pool(3000)}, {docs("top3", 3)}, {GOLD}, {POPULAR},
every AS (SELECT qid, doc_id, min((kind, p)) AS spot FROM (SELECT qid, doc_id, rnk AS p, 0 AS kind FROM ranked UNION ALL SELECT qid, doc_id, place, 1 FROM asked, popular) GROUP BY ALL),
padded AS (SELECT qid, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spot) AS place FROM every) WHERE place <= 5)"""
ANSWERS = f"{PADDED}, answers AS (SELECT qid, list(doc_id::VARCHAR ORDER BY place) AS answer FROM padded GROUP BY qid)"

_BY = ", fusion"
COMPARED = f"""{POOLED}, mm AS (SELECT *, {minmax("dense")} AS md, {minmax("score")} AS ms, {RRF} AS rrf FROM dense),
configs AS (SELECT qid, chunk_idx, doc_id, unnest([{{'fusion': 'bm25', 'v': score}}, {{'fusion': 'dense', 'v': dense}}, {{'fusion': 'rrf', 'v': rrf}}, {{'fusion': 'linear_0.3', 'v': 0.3::DOUBLE * md + (1 - 0.3::DOUBLE) * ms}}, {{'fusion': 'linear_0.5', 'v': 0.5::DOUBLE * md + (1 - 0.5::DOUBLE) * ms}}, {{'fusion': 'linear_0.7', 'v': 0.7::DOUBLE * md + (1 - 0.7::DOUBLE) * ms}}]) AS c FROM mm),
fpool AS (SELECT qid, fusion, chunk_idx, doc_id, score, row_number() OVER (PARTITION BY qid, fusion ORDER BY round(score, 9) DESC, chunk_idx) AS rnk FROM (SELECT qid, chunk_idx, doc_id, c.fusion AS fusion, c.v AS score FROM configs))"""

_GRID = f"WITH {INDEX}, {questions()}, params AS (SELECT k1, b FROM (VALUES (0.6::DOUBLE), (0.9::DOUBLE), (1.2::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) a(k1), (VALUES (0.4::DOUBLE), (0.6::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) c(b)), {scores(k1='k1', b='b', params='params')}, {pool(3000, by=', k1, b')}, {docs('top3', 20, by=', k1, b')}, {GOLD}, {metrics(by=', k1, b')}"
_FUSIONS = f"{COMPARED}, {docs('top3', 20, source='fpool', by=_BY)}, {GOLD}, {metrics(by=_BY)}"
_AGGREGATORS = f"""{BM25}, {pool(3000)}, {docs("max", 20, "r1")}, {docs("top3", 20, "r2")}, {docs("top3_log", 20, "r3")}, {GOLD},
ranked AS (SELECT *, 'max' AS agg FROM r1 UNION ALL SELECT *, 'top3' FROM r2 UNION ALL SELECT *, 'top3_log' FROM r3), {metrics(by=", agg")}"""
_ASKED = f"list_distinct({tokens('question')})"
_SEEN = tokens("c.text")
_LOGITS = f"logits AS (SELECT candidates.*, CASE WHEN len({_ASKED}) > 0 THEN len(list_intersect({_ASKED}, list_distinct({_SEEN})))::DOUBLE / len({_ASKED}) ELSE 0 END AS logit FROM candidates JOIN asked USING (qid) JOIN (SELECT chunk_idx, text FROM chunks) c USING (chunk_idx)), blended AS (SELECT qid, chunk_idx, doc_id, 0.6::DOUBLE * {minmax('logit')} + (1 - 0.6::DOUBLE) * {minmax('fused')} AS fused FROM logits)"
# A reranker sees the whole pool of a question.
_EVERY = f"{fused(LINEAR)}, candidates AS (SELECT * FROM fused)"
_SYSTEMS = f"""{_EVERY}, {_LOGITS}, {REFUSED}, {docs("top3", 20, "r1", "fpool")}, {REFUSED.replace("fpool AS", "bpool AS").replace("FROM fused", "FROM blended")}, {docs("top3", 20, "r2", "bpool")}, {GOLD},
ranked AS (SELECT *, 'hybrid' AS system FROM r1 UNION ALL SELECT *, 'reranked' FROM r2), {metrics(by=", system")}"""


def snippets(ranked: str) -> str:
    """What a search shows of ``ranked`` (qid, rnk, doc_id, score, best_chunk, n_chunk); a row's number stands for its keys."""
    return rf"""best AS (SELECT *, qid * 100 + rnk AS row_no FROM (SELECT {ranked}) JOIN (SELECT chunk_idx AS best_chunk, path, n_words, text FROM chunks) USING (best_chunk)),
shown AS (SELECT row_no AS doc_id, regexp_replace(text, '^[^\n]*\n?', '') AS text FROM best), {REFLOW.replace("FROM documents", "FROM shown")},
snippets AS (SELECT doc_id AS row_no, left(string_agg(line, ' ' ORDER BY line_no), 260) AS snippet FROM lines GROUP BY doc_id)
SELECT qid, rnk, doc_id, path, round(score, 2) AS score, split_part(split_part(text, chr(10), 1), ' > ', 1) AS title, n_words, 3 AS tier, coalesce(snippet, '') AS snippet, n_chunk FROM best LEFT JOIN snippets USING (row_no)"""


_VIEW = f"""WITH shown AS (SELECT doc_id, {CLEAN.format("text")} AS text FROM documents), {REFLOW.replace("FROM documents", "FROM shown")},
html AS (SELECT doc_id, string_agg('<' || {_UNIT} || '>' || {ESCAPED} || '</p>', chr(10) ORDER BY line_no) AS html FROM lines GROUP BY doc_id)
SELECT doc_id, true AS found, length(text) > 400000 AS truncated, md5(coalesce(html, '<p class="empty"></p>')) AS digest FROM shown LEFT JOIN html USING (doc_id)
UNION ALL SELECT -1 - doc_id, false, NULL, NULL FROM documents"""

def _run(i: int, j: int) -> str:
    return f"array_to_string(w[{i}:{j}], ' ')"


# The statutes of the query, chunk by chunk: a preamble and two short articles, two groups of clauses, three windows.
_STATUTE = (
    (1, "Phần mở đầu + Điều 2", f"{_run(961, 990)} || chr(10) || 'Điều 1. Mở đầu' || chr(10) || {_run(1, 40)} || chr(10) || 'Điều 2. Ngắn' || chr(10) || {_run(41, 50)}", 87),
    (2, "Điều 3 > Khoản 1", f"'Điều 3. Dài' || chr(10) || '1. ' || {_run(51, 250)}", 204), (2, "Điều 3 > Khoản 2-3", f"'Điều 3. Dài' || chr(10) || '2. ' || {_run(251, 450)} || chr(10) || '3. ' || {_run(451, 460)}", 215),
    (2, "Điều 4 > phần 1", f"'Điều 4. Rất dài ' || {_run(461, 712)}", 256), (2, "Điều 4 > phần 2", f"'Điều 4. Rất dài' || chr(10) || {_run(649, 904)}", 260), (2, "Điều 4 > phần 3", f"'Điều 4. Rất dài' || chr(10) || {_run(841, 960)}", 124),
)
_PIECES = ", ".join(f"{{'o': {i}, 'tier': {tier}, 'path': '{path}', 'body': {body}, 'n': {n}}}" for i, (tier, path, body, n) in enumerate(_STATUTE))
_STRUCTURE = f"""WITH found AS (SELECT doc_id, trim(replace(source, '-', ' ')) AS title, regexp_extract_all(lower(text), '[a-z]+') AS f FROM documents),
filled AS (SELECT doc_id, title, CASE WHEN len(f) > 0 THEN f ELSE ['w'] END AS f FROM found),
worded AS (SELECT doc_id, title, list_transform(range(0, 1000), lambda i: f[i % len(f) + 1]) AS w FROM filled),
cut AS (SELECT doc_id, title, unnest([{_PIECES}]) AS p FROM worded)
SELECT doc_id * 2 AS doc_id, (doc_id * 2) || '#' || p.o AS chunk_id, p.o::BIGINT AS ordinal, p.tier AS tier, p.path AS path, p.n::BIGINT AS n_words, md5(title || ' > ' || p.path || chr(10) || p.body) AS digest FROM cut
UNION ALL SELECT doc_id * 2 + 1, (doc_id * 2 + 1) || '#t0', 0, 0, 'title-only', len(list_filter(string_split(title, ' '), lambda x: x <> '')), md5(title) FROM found"""

ORACLES = {
    "tokenize_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "doc_freq": f"WITH {INDEX} SELECT term, df FROM dfs",
    "vocab_pruned": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM vocab",
    "pruning_counts": f"WITH {INDEX} SELECT count(*) FILTER (WHERE df BETWEEN 2 AND floor(n_chunks * 0.7::DOUBLE)) AS kept, count(*) FILTER (WHERE df < 2) AS rare, count(*) FILTER (WHERE df > floor(n_chunks * 0.7::DOUBLE)) AS common FROM dfs, corpus",
    "postings_tf": f"WITH {INDEX} SELECT term, chunk_idx, tf FROM tf SEMI JOIN vocab USING (term)",
    "corpus_stats": f"WITH {INDEX} SELECT n_chunks, round(avgdl, 6) AS avgdl, (SELECT sum(df) FROM vocab)::BIGINT AS nnz, (SELECT count(*) FROM vocab) AS vocab_size FROM corpus",
    "chunks_per_doc": f"WITH {CHUNKS} SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id",
    "clean_text": f"SELECT doc_id, md5({CLEAN.format('text')}) AS digest FROM documents",
    "title_from_slug": "SELECT page_id, trim(replace(regexp_extract(url || '/van-ban-' || page_id || '-7.aspx', '/([^/]+?)-[0-9]+\\.aspx', 1), '-', ' ')) AS title FROM pages",
    "chunk_windows": f"WITH {CHUNKS} SELECT doc_id, chunk_id, i AS ordinal, 3 AS tier, path, n_words, text FROM chunks",
    "chunk_structure": _STRUCTURE,
    "chunk_tier_counts": f"WITH {CHUNKS} SELECT 3 AS tier, count(*) AS n_chunks, sum(n_words)::BIGINT AS n_words FROM chunks",
    "bm25_chunks_topk": f"{BM25}, {pool(10)} SELECT qid, chunk_idx, doc_id, round(score, 6) AS score, rnk FROM pool",
    "bm25_bounded_topk": f"{BM25}, {pool(10)} SELECT qid, chunk_idx, doc_id, round(score, 6) AS score, rnk FROM pool",
    "bm25_bounded_tally": f"{BM25} SELECT count(*) AS n_matched, true AS fewer FROM scores_qt JOIN vocab USING (term) JOIN tf USING (term)",
    **{f"bm25_docs_{a}": f"{BM25}, {pool(3000)}, {docs(a, 5)} {RANKED}" for a in ("max", "top3", "top3_log")},
    "bm25_hit_terms": f"WITH {INDEX}, {questions()}, each AS (SELECT qid, unnest({tokens('question')}) AS term, generate_subscripts({tokens('question')}, 1) AS pos FROM asked) SELECT qid, array_to_string(list(term ORDER BY pos), ' ') AS terms FROM each SEMI JOIN vocab USING (term) GROUP BY qid",
    "matryoshka_dot": "WITH cut AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6) AS dot FROM cut a JOIN cut b ON b.vec_id = a.vec_id + 1",
    "dense_topk": f"{POOLED} SELECT qid, chunk_idx, doc_id, round(dense, 6) AS dense, rnk FROM (SELECT qid, chunk_idx, doc_id, dense, row_number() OVER (PARTITION BY qid ORDER BY round(dense, 9) DESC, chunk_idx) AS rnk FROM dense) WHERE rnk <= 10",
    "minmax_pool": f"{POOLED} SELECT qid, chunk_idx, round({minmax('score')}, 6) AS bm25, round({minmax('dense')}, 6) AS dense FROM dense",
    "fusion_linear": f"{fused(LINEAR)} SELECT qid, chunk_idx, round(fused, 6) AS fused FROM fused",
    "fusion_rrf": f"{fused(RRF)} SELECT qid, chunk_idx, round(fused, 6) AS fused FROM fused",
    "hybrid_docs": f"{fused(LINEAR)}, {REFUSED}, {docs('top3', 5, source='fpool')} {RANKED}",
    "rerank_candidates": f"{CANDIDATES} SELECT qid, chunk_idx, doc_id, rn, in_doc FROM candidates",
    "rerank_blend": f"{_EVERY}, {_LOGITS}, {REFUSED.replace('FROM fused', 'FROM blended')}, {docs('top3', 5, source='fpool')} {RANKED}",
    "bm25_expanded_docs": f"WITH {VARIANTS}, combined AS (SELECT qid, chunk_idx, doc_id, greatest(o, e) AS score FROM both_), {pool(1000, source='combined')}, {docs('top3', 5)} {RANKED}",
    "encode_lengths": f"WITH {CHUNKS}, sized AS (SELECT len({tokens('text')}) AS n FROM chunks) SELECT count(*) AS n_texts, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS longest, round(avg((n > 128)::INT), 6) AS truncated FROM sized",
    "expand_rules": f"WITH {EXPANSIONS} SELECT qid, array_to_string(terms, '|') AS terms, normalized AS normalized_query FROM expanded",
    "expand_filter": f"WITH {FILTERS} SELECT qid, CASE WHEN lower(a) = lower(b) THEN a ELSE a || '|' || b END AS terms FROM (SELECT qid, regexp_replace(terms[1], '\\s+', ' ', 'g') AS a, regexp_replace(split_part(question, ' ', 2), '\\s+', ' ', 'g') || ' end' AS b FROM proposed)",
    "expanded_query": f"WITH {EXPANSIONS} SELECT qid, regexp_replace(question || ' ' || normalized || ' ' || array_to_string(terms, ' ') || ' ' || array_to_string(terms[1:4], ' '), '^\\s+|\\s+$', '', 'g') AS question FROM expanded",
    "expand_resume": "SELECT conv_id * 1000 + turn AS qid FROM conversations WHERE role = 'user' AND turn > 0",
    "combine_max": f"WITH {VARIANTS} SELECT qid, chunk_idx, round(greatest(o, e), 6) AS score FROM both_",
    "combine_interpolate": f"WITH {VARIANTS} SELECT qid, chunk_idx, round((1 - 0.3::DOUBLE) * o + 0.3::DOUBLE * e, 6) AS score FROM both_",
    "gold_pairs": f"WITH {GOLD} SELECT qid, doc_id FROM gold",
    "eval_metrics": f"{BM25}, {pool(3000)}, {docs('top3', 20)}, {GOLD}, {metrics()} SELECT {MEANS} FROM measured",
    "rank_histogram": f"{BM25}, {pool(3000)}, {docs('top3', 20)}, {GOLD}, {metrics()} SELECT CASE WHEN first = 1 THEN '1' WHEN first <= 3 THEN '2-3' WHEN first <= 5 THEN '4-5' WHEN first <= 10 THEN '6-10' WHEN first <= 20 THEN '11-20' ELSE 'outside' END AS bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM measured), 6) AS percent FROM measured GROUP BY 1",
    "bm25_grid": f"{_GRID} SELECT k1, b, {MEANS} FROM measured GROUP BY k1, b",
    "grid_deltas": f"{_GRID}, r AS (SELECT k1, b, avg(recall) AS recall FROM measured GROUP BY k1, b) SELECT k1, b, round(recall, 6) AS recall, round(recall - (SELECT recall FROM r WHERE k1 = 1.5 AND b = 0.75), 6) AS delta FROM r",
    "grid_best": f"{_GRID} SELECT k1, b, {MEANS} FROM measured GROUP BY k1, b ORDER BY round(avg(measured.recall), 9) DESC, k1, b LIMIT 1",
    "grid_matrix": f"{_GRID} SELECT k1, {', '.join(f'round(avg(recall) FILTER (WHERE b = {x / 100}), 6) AS b_{x}' for x in (40, 60, 75, 90))} FROM measured GROUP BY k1",
    "best_aggregator": f"{_AGGREGATORS} SELECT agg, {MEANS} FROM measured GROUP BY agg ORDER BY round(avg(measured.recall), 9) DESC, agg LIMIT 1",
    "fusion_compare": f"{_FUSIONS} SELECT fusion, {MEANS} FROM measured GROUP BY fusion",
    "fusion_deltas": f"{_FUSIONS}, r AS (SELECT fusion, avg(recall) AS recall FROM measured GROUP BY fusion) SELECT fusion, round(recall, 6) AS recall, round(recall - (SELECT recall FROM r WHERE fusion = 'bm25'), 6) AS delta FROM r",
    "rerank_compare": f"{_SYSTEMS}, r AS (SELECT system, avg(recall) AS recall, avg(rr) AS mrr FROM measured GROUP BY system) SELECT system, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(recall - (SELECT recall FROM r WHERE system = 'hybrid'), 6) AS delta FROM r",
    "fallback_popular": f"WITH {GOLD}, {POPULAR} SELECT doc_id, place FROM popular",
    "pad_answers": f"{PADDED} SELECT qid, doc_id, place FROM padded",
    "submission_rows": f"{ANSWERS} SELECT qid, array_to_string(answer, ',') AS answer FROM answers",
    "answer_length_hist": f"{ANSWERS} SELECT len(answer) AS n_ids, count(*) AS n_questions FROM answers GROUP BY 1",
    "prediction_summary": f"{PADDED} SELECT (SELECT count(DISTINCT qid) FROM padded) AS n_questions, (SELECT count(DISTINCT doc_id) FROM padded) AS n_documents, (SELECT count(*) FROM asked WHERE qid NOT IN (SELECT qid FROM ranked GROUP BY qid HAVING count(*) >= 5)) AS n_padded",
    "search_results": f"{BM25}, {pool(3000)}, {docs('max', 5)}, {snippets('* FROM ranked')}",
    "search_requests": f"{BM25}, {pool(3000)}, {docs('max', 100)}, termed AS (SELECT qid, (SELECT count(*) FROM (SELECT unnest({tokens('question')}) AS term) SEMI JOIN vocab USING (term)) AS n_terms FROM asked) SELECT qid, n_terms, rnk, doc_id, round(score, 2) AS score FROM termed LEFT JOIN ranked USING (qid) WHERE rnk <= greatest(1, qid % 7) OR rnk IS NULL UNION ALL SELECT max(item_id) + 1, 0, NULL, NULL, NULL FROM benchmark",
    "search_chunks": f"{BM25}, {pool(5)}, {snippets('qid, rnk, doc_id, score, chunk_idx AS best_chunk, 1 AS n_chunk FROM pool')}",
    "known_terms": f"WITH {INDEX}, {questions()}, each AS (SELECT DISTINCT qid, unnest({tokens('question')}) AS term FROM asked) SELECT qid, string_agg(term, ' ' ORDER BY term) AS terms FROM each SEMI JOIN vocab USING (term) GROUP BY qid",
    "document_view": _VIEW,
    "validate_findings": f"WITH {FINDINGS} SELECT CASE code[1] WHEN 'E' THEN 'error' ELSE 'warning' END AS severity, code, title, count(*) AS n, array_to_string(list_sort(list(DISTINCT what))[1:5], ',') AS examples FROM broken JOIN titles USING (code) GROUP BY code, title",
    "submission_statistics": f"WITH {SUBMISSION} SELECT 'made' AS sub_id, (SELECT count(*) FROM latest) AS n_questions, (SELECT count(*) FROM typed WHERE t = 'ARRAY') AS n_answers, (SELECT count(*) FROM ids) AS n_entries, (SELECT count(doc_id) FROM ids) AS n_ids, (SELECT count(DISTINCT doc_id) FROM ids) AS n_documents, (SELECT count(*) FROM typed WHERE t = 'ARRAY' AND json_array_length(a) = 0) AS n_empty, (SELECT count(*) FROM typed WHERE t = 'ARRAY' AND json_array_length(a) > 5) AS n_over_limit",
    "submission_lengths": f"WITH {SUBMISSION} SELECT 'made' AS sub_id, json_array_length(a)::BIGINT AS n_ids, count(*) AS n_questions FROM typed WHERE t = 'ARRAY' GROUP BY ALL",
    "validate_unreadable": "SELECT item_id || k AS sub_id, code, 1 AS n FROM benchmark, (VALUES ('-text', 'E003'), ('-list', 'E004'), ('-empty', 'E004')) v(k, code)",
    "expansion_cache": f"WITH {EXPANSIONS} SELECT qid::VARCHAR AS qid, CASE WHEN length(question) % 3 = 0 THEN array_to_string(terms, '|') ELSE 'alpha beta|' || split_part(question, ' ', 1) END AS terms, CASE WHEN length(question) % 3 = 0 THEN normalized ELSE question END AS normalized_query, CASE WHEN length(question) % 6 = 0 THEN 'fallback_rules_after_error: KeyError' WHEN length(question) % 3 = 0 THEN 'fallback_rules_after_error: ValueError' ELSE 'echo' END AS source FROM expanded",
    "reflow_text": f"WITH {REFLOW} SELECT doc_id, line_no, line FROM lines",
    "highlight": f"WITH {REFLOW} SELECT doc_id, line_no, {_marked(_marked(ESCAPED))} AS html FROM lines",
    "structure_classify": f"WITH {REFLOW} SELECT doc_id, line_no, {_UNIT} AS unit FROM lines",
    "length_percentiles": "SELECT round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.99), 6) AS p99, max(n_chars) AS longest, count(*) FILTER (WHERE n_chars > 5000) AS n_long FROM documents",
    "json_recovery": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
}
