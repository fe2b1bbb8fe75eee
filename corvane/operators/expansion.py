"""Query expansion by rules, filtering of expansions, expanded queries and their combination with the original scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import json as J
from corvane.functions import text as T
from corvane.sources.corpus import append_expansions, cached_expansions
from corvane.sources.products import stored

MOST_TERMS, REPEATED, WEIGHT = 12, 4, 0.3
#: Jobs in which the batches of a cache are written at most, however many these are.
ROUNDS = 8

# Abbreviations and phrase rules of the legal questions that the defaults are for, in order.
ABBREVIATIONS = (
    ("cccd", "căn cước công dân"), ("cmnd", "chứng minh nhân dân"), ("bhxh", "bảo hiểm xã hội"), ("bhyt", "bảo hiểm y tế"), ("ubnd", "ủy ban nhân dân"),
    ("tand", "tòa án nhân dân"), ("vksnd", "viện kiểm sát nhân dân"), ("gtgt", "giá trị gia tăng"), ("tncn", "thu nhập cá nhân"), ("atgt", "an toàn giao thông"),
)
PHRASES = (
    ("bao nhiêu tiền|tốn bao nhiêu|chi phí|mất bao nhiêu", ("mức thu", "lệ phí", "phí", "đồng", "không có")),
    ("bao nhiêu ngày|bao lâu|trong khoảng thời gian nào", ("thời hạn", "thời gian", "ngày làm việc", "không quá", "trong ngày")),
    ("giấy tờ gì|cần chuẩn bị những giấy tờ gì|hồ sơ gồm|hồ sơ.*cần", ("hồ sơ", "văn bản", "bản chính", "bản sao", "tờ khai", "tài liệu")),
    ("có được|được phép|có phải|có bắt buộc", ("được phép", "không được", "bị cấm", "điều kiện", "trách nhiệm")),
    ("bị phạt|mức phạt|xử phạt|phạt tiền", ("xử phạt", "mức phạt", "phạt tiền", "vi phạm hành chính")),
    ("thủ tục", ("trình tự", "cách thức thực hiện", "hồ sơ", "cơ quan giải quyết")),
)
#: A reference to an article or clause.
REFERENCE = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(điều|khoản){T.SPACE}+\p{{Nd}}+"
CONTEXT_ID = r"(?iu)(?<![\p{L}\p{N}_])context_\p{Nd}+(?![\p{L}\p{N}_])"
FILTER_TOKEN = "[0-9A-Za-zÀ-ỹ]+"


def deduped(terms: Column) -> Column:
    """Terms with white space folded, blanks and repetitions (case aside) left out, the first of equals kept."""
    folded = F.filter(F.transform(terms, lambda t: T.strip(F.regexp_replace(t, rf"{T.SPACE}+", " "))), lambda t: t != "")
    lowered = F.transform(folded, F.lower)
    return F.transform(F.filter(F.transform(folded, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: F.array_position(lowered, F.lower(x["t"])) == x["i"] + 1), lambda x: x["t"])


def rule_terms(question: Column, abbreviations=ABBREVIATIONS, phrases=PHRASES) -> Column:
    """Terms that the rules add to a question, in the order of the rules, at most MOST_TERMS."""
    q = F.lower(T.text_of(question))
    none = F.array().cast("array<string>")
    parts = [F.when(q.rlike("(?iu)" + T.whole_word(short)), F.array(F.lit(full))).otherwise(none) for short, full in abbreviations]
    parts += [F.when(q.rlike("(?iu)" + pattern), F.array(*map(F.lit, terms))).otherwise(none) for pattern, terms in phrases]
    return F.slice(deduped(F.flatten(F.array(*parts))), 1, MOST_TERMS)


def expand_rules(questions: DataFrame, **rules) -> DataFrame:
    """``questions`` (qid, question) with normalized_query and expansion_terms by the rules, and source ``rules``."""
    made = questions.withColumn("expansion_terms", rule_terms(F.col("question"), **rules))
    return made.withColumn("normalized_query", T.strip(F.concat_ws(" ", "question", F.array_join(F.slice("expansion_terms", 1, REPEATED), " ")))).withColumn("source", F.lit("rules"))


def filter_expansions(proposed: DataFrame, most: int = MOST_TERMS, **rules) -> DataFrame:
    """``proposed`` (qid, question, normalized_query, expansion_terms) without terms that a question does not support: new
    numbers, document ids, new article references, more than six tokens; rule terms where none is left."""
    numbers = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\p{Nd}+)"), F.lit(1))
    q = T.text_of("question")

    def fit(term: Column) -> Column:
        new_numbers = F.size(F.array_except(numbers(term), numbers(q))) > 0
        new_reference = term.rlike(REFERENCE) & ~q.rlike(REFERENCE)
        return ~new_numbers & ~term.rlike(CONTEXT_ID) & ~new_reference & (F.size(F.regexp_extract_all(term, F.lit(f"({FILTER_TOKEN})"), F.lit(1))) <= 6)

    kept = F.slice(F.filter(deduped(F.coalesce("expansion_terms", F.array().cast("array<string>"))), fit), 1, most)
    filled = proposed.withColumn("kept_", kept).withColumn("expansion_terms", F.when(F.size("kept_") > 0, F.col("kept_")).otherwise(rule_terms(F.col("question"), **rules)))
    return filled.withColumn("normalized_query", F.coalesce(F.nullif("normalized_query", F.lit("")), "question")).drop("kept_")


def expanded_queries(questions: DataFrame, expansions: DataFrame, repeated: int = REPEATED) -> DataFrame:
    """(qid, question) where the question is followed by its expansion and its first terms again, which weighs these more.
    A question without an expansion stays as it is."""
    terms = F.filter("expansion_terms", lambda t: T.strip(t) != "")
    joined = questions.join(expansions.select("qid", "normalized_query", "expansion_terms"), "qid", "left")
    whole = T.strip(F.concat_ws(" ", "question", T.text_of("normalized_query"), F.array_join(terms, " "), F.array_join(F.slice(terms, 1, repeated), " ")))
    return joined.select("qid", F.when(F.col("expansion_terms").isNull(), F.col("question")).otherwise(whole).alias("question"))


def combine(original: DataFrame, expanded: DataFrame, mode: str = "max", weight: float = WEIGHT) -> DataFrame:
    """Scores (qid, chunk_idx, doc_id, score) of both query variants as one: ``off``, ``expanded``, ``max`` or
    ``interpolate``. A chunk without a score counts as 0."""
    if mode == "off":
        return original
    if mode == "expanded":
        return expanded
    keys = ["qid", "chunk_idx", "doc_id"]
    both = original.select(*keys, F.col("score").alias("o"), F.lit(0.0).alias("e")).unionByName(expanded.select(*keys, F.lit(0.0).alias("o"), F.col("score").alias("e"))).groupBy(*keys).agg(F.max("o").alias("o"), F.max("e").alias("e"))
    value = F.greatest("o", "e") if mode == "max" else (1 - weight) * F.col("o") + weight * F.col("e")
    return both.select(*keys, value.alias("score")).where("score > 0")


def missing(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions that the cache of expansions lacks: what a resumed run has left to do."""
    return questions.join(cache.select("qid"), "qid", "left_anti")


def generated(questions: DataFrame, generate: Callable[[list[str]], list[str]], name: str, **rules) -> DataFrame:
    """``questions`` (qid, question) with normalized_query, expansion_terms and ``source``, from a model's texts.

    ``generate`` gives a text for each of a list of questions; the JSON object in it is recovered and its terms filtered. Where
    it raises, its questions are asked one by one; a question that raises alone, or whose text holds no object, gets the terms
    of the rules, and its source says which error that was.
    """

    def run(frames):
        for frame in frames:
            asked = frame["question"].fillna("").tolist()
            try:
                answers = [(x, None) for x in generate(asked)]
                if len(answers) != len(asked):
                    raise ValueError(f"{len(answers)} texts for {len(asked)} questions")
            except Exception:  # noqa: BLE001 - whatever a model raises, the others of its batch are asked alone
                answers = []
                for q in asked:
                    try:
                        (one,) = generate([q])
                        answers.append((one, None))
                    except Exception as e:  # noqa: BLE001
                        answers.append((None, type(e).__name__))
            frame["answer_"], frame["error_"] = [a for a, _ in answers], [e for _, e in answers]
            yield frame

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in questions.schema)}, answer_ string, error_ string"
    found = questions.mapInPandas(run, schema).withColumn("made_", J.recovered(F.col("answer_"), "normalized_query string, expansion_terms array<string>"))
    failed = F.when(F.col("error_").isNotNull(), F.col("error_")).when(F.col("made_").isNull(), F.lit("ValueError"))
    proposed = found.select(*questions.columns, F.col("made_.normalized_query").alias("normalized_query"), F.col("made_.expansion_terms").alias("expansion_terms"), failed.alias("failed_"))
    filtered = filter_expansions(proposed, **rules)
    plain = rule_terms(F.col("question"), **rules)
    by_rules = T.strip(F.concat_ws(" ", "question", F.array_join(F.slice(plain, 1, REPEATED), " ")))
    broken = F.col("failed_").isNotNull()
    source = F.when(broken, F.concat(F.lit("fallback_rules_after_error: "), F.col("failed_"))).otherwise(F.lit(name))
    return filtered.withColumn("expansion_terms", F.when(broken, plain).otherwise(F.col("expansion_terms"))).withColumn("normalized_query", F.when(broken, by_rules).otherwise(F.col("normalized_query"))).withColumn("source", source).drop("failed_")


def build_cache(questions: DataFrame, path: str, expand: Callable[[DataFrame], DataFrame], batch_rows: int = 1000) -> DataFrame:
    """The cache at ``path``, made whole for ``questions`` (qid, question) by ``expand`` (``expand_rules`` or ``generated``).

    Questions that the cache has are not expanded again. The others are dealt into batches by a hash of their qid, a folder
    each, which are written in at most ``ROUNDS`` jobs: a run that is interrupted keeps what its whole jobs hold, and one that
    is repeated gives the same rows.
    """
    spark = questions.sparkSession
    asked = questions.select(F.col("qid").cast("string").alias("qid"), "question").where("qid is not null").dropDuplicates(["qid"])
    held = cached_expansions(spark, path)
    last = held.agg(F.max("batch")).first()[0]
    # Written: each job reads its own questions of them, and none looks into the cache or for repeated ones again.
    left = stored(missing(asked, held), "questions")
    n, first = -(-left.count() // batch_rows), 0 if last is None else last + 1
    part, step = F.pmod(F.xxhash64("qid"), F.lit(max(1, n))), max(1, -(-n // ROUNDS))
    # A number of tasks is given, as few questions are much work for a model.
    tasks = min(step, 4 * spark.sparkContext.defaultParallelism)
    for begin in range(0, n, step):
        of_job = left.where(part.between(begin, begin + step - 1))
        append_expansions(expand(of_job.repartition(tasks, part) if step > 1 else of_job), path, part + F.lit(first))
    return cached_expansions(spark, path)
