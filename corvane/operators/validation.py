"""Rules for submissions: all findings at once, none hides another.

A submission is one row of text (``json``). Its value is read as VARIANT with repeated keys allowed, so that the last of
them counts, and the keys alone say which repeat.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.functions import text as T

EXAMPLES, MOST_IDS = 5, 5

# Codes and titles of the rules.
TITLES = {
    "E001": "no submission in the file", "E002": "other files in the zip", "W003": "files of an operating system in the zip", "W004": "bare JSON, no zip",
    "E003": "not valid JSON", "E004": "top level is no object or empty", "E005": "missing questions", "E006": "unexpected questions", "E007": "value is no object", "E008": "no answer",
    "E009": "answer is no list", "E010": "document id is no string", "E011": "blank document id", "E012": "repeated document id", "E013": "repeated question", "E014": "unknown document id",
    "W001": "empty answer", "W002": "more than five ids", "W005": "no reference given",
}


def parse(submissions: DataFrame) -> DataFrame:
    """``submissions`` (sub_id, json) with the parsed value ``v``, null if it isn't JSON."""
    submissions.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return submissions.withColumn("v", F.try_parse_json(F.regexp_replace("json", "\\A﻿", "")))


def entries(parsed: DataFrame) -> DataFrame:
    """(sub_id, qid, value, kind) of each question of the submissions whose top level is an object."""
    return parsed.where(F.schema_of_variant("v").startswith("OBJECT")).select("sub_id", "v").lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer())).select("sub_id", F.col("key").alias("qid"), F.col("value"), F.schema_of_variant("value").alias("kind"))


@F.pandas_udf(StringType())
def _position(texts: pd.Series) -> pd.Series:
    """Where a text stops being JSON."""

    def where(text: str) -> str:
        def no_value(name: str) -> None:
            raise ValueError(f"{name} is no value")

        try:
            json.loads(text, parse_constant=no_value)
        except json.JSONDecodeError as e:
            return f"line {e.lineno}, column {e.colno}"
        except RecursionError:
            return "nested too deep"
        except ValueError as e:
            return str(e)
        return "no JSON value"

    return texts.map(where, na_action="ignore")


def findings(submissions: DataFrame, reference: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """severity, code, title, n and up to five examples for each rule that a submission breaks.

    ``submissions``: sub_id, json. ``reference``: qid, the questions asked. ``corpus``: doc_id, the documents known.
    """
    return _summarised(_broken(submissions, reference, corpus))


def report(files: DataFrame, reference: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """``findings`` of submission files (sub_id, json, file_findings), what the files themselves show among them. A file
    without readable text has these alone."""
    of_files = files.select("sub_id", F.inline("file_findings")).select("sub_id", "code", F.col("detail").alias("what"))
    return _summarised(of_files.unionByName(_broken(files.where("json is not null").select("sub_id", "json"), reference, corpus)))


def _lists(submissions: DataFrame) -> DataFrame:
    """(sub_id, qid, ids) of each question of the submissions that are objects; ids are null where there is no list."""
    return entries(parse(submissions)).select("sub_id", "qid", F.expr("try_variant_get(value, '$.answer', 'array<variant>')").alias("ids"))


def statistics(submissions: DataFrame) -> DataFrame:
    """(sub_id, n_questions, n_answers, n_entries, n_ids, n_documents, n_empty, n_over_limit) of each submission that is an
    object: questions, those with a list, entries of all lists, those of them that have a text, different ones, lists without
    an entry and those with more than five."""
    rows = _lists(submissions)
    each = rows.select("sub_id", F.explode("ids").alias("id")).withColumn("doc_id", F.expr("try_variant_get(id, '$', 'string')"))
    ids = each.groupBy("sub_id").agg(F.count(F.lit(1)).alias("n_entries"), F.count("doc_id").alias("n_ids"), F.count_distinct("doc_id").alias("n_documents"))
    size = F.when(F.col("ids").isNotNull(), F.size("ids"))
    lists = rows.groupBy("sub_id").agg(F.count(F.lit(1)).alias("n_questions"), F.count("ids").alias("n_answers"), F.count_if(size == 0).alias("n_empty"), F.count_if(size > MOST_IDS).alias("n_over_limit"))
    joined = lists.join(ids, "sub_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select("sub_id", "n_questions", "n_answers", none("n_entries"), none("n_ids"), none("n_documents"), "n_empty", "n_over_limit")


def length_distribution(submissions: DataFrame) -> DataFrame:
    """(sub_id, n_ids, n_questions): how many questions have a list of so many ids."""
    return _lists(submissions).where("ids is not null").groupBy("sub_id", F.size("ids").cast("long").alias("n_ids")).agg(F.count(F.lit(1)).alias("n_questions"))


def _broken(submissions: DataFrame, reference: DataFrame | None, corpus: DataFrame | None) -> DataFrame:
    """(sub_id, code, what): one row for each breach of a rule."""
    parsed = parse(submissions)
    top = F.schema_of_variant("v")
    broken = [parsed.where(F.col("v").isNull()).select("sub_id", F.lit("E003").alias("code"), _position(F.regexp_replace("json", "\\A\ufeff", "")).alias("what"))]
    broken.append(parsed.where(F.col("v").isNotNull() & (~top.startswith("OBJECT") | (top == "OBJECT<>"))).select("sub_id", F.lit("E004").alias("code"), top.alias("what")))
    rows = entries(parsed)
    answer = F.try_variant_get("value", "$.answer", "variant")
    held = rows.withColumn("is_object", F.col("kind").startswith("OBJECT")).withColumn("answer", F.when(F.col("kind").startswith("OBJECT"), answer))
    typed = held.withColumn("type", F.schema_of_variant("answer"))
    rule = lambda df, code, what="qid": df.select("sub_id", F.lit(code).alias("code"), F.col(what).cast("string").alias("what"))
    broken.append(rule(typed.where(~F.col("is_object")), "E007"))
    broken.append(rule(typed.where(F.col("is_object") & F.col("type").isNull()), "E008"))
    broken.append(rule(typed.where(F.col("is_object") & F.col("type").isNotNull() & ~F.col("type").startswith("ARRAY")), "E009"))
    lists = typed.where(F.col("type").startswith("ARRAY")).withColumn("ids", F.expr("cast(answer as array<variant>)"))
    broken.append(rule(lists.where(F.size("ids") == 0), "W001"))
    broken.append(rule(lists.where(F.size("ids") > MOST_IDS), "W002"))
    ids = lists.select("sub_id", "qid", F.explode("ids").alias("id")).select("sub_id", "qid", F.schema_of_variant("id").alias("t"), F.expr("try_variant_get(id, '$', 'string')").alias("doc_id"))
    strings = ids.where("t = 'STRING'")
    blank = T.strip("doc_id") == ""
    broken.append(rule(ids.where(F.col("t").isNull() | (F.col("t") != "STRING")), "E010"))
    broken.append(rule(strings.where(blank), "E011"))
    repeated = strings.groupBy("sub_id", "qid", "doc_id").count().where("count > 1")
    broken.append(rule(repeated.select("sub_id", "qid").distinct(), "E012"))  # a question counts once
    keys = parsed.where(F.col("v").isNotNull()).select("sub_id", F.explode(F.json_object_keys("json")).alias("qid"))
    broken.append(rule(keys.groupBy("sub_id", "qid").count().where("count > 1"), "E013"))
    if corpus is not None:
        known = corpus.select(F.col("doc_id").cast("string").alias("doc_id"))
        broken.append(rule(strings.where(~blank).join(known, "doc_id", "left_anti"), "E014", "doc_id"))
    if reference is None:
        broken.append(submissions.select("sub_id", F.lit("W005").alias("code"), F.lit("").alias("what")))
    else:
        asked = reference.select(F.col("qid").cast("string").alias("qid"))
        # A row for each question of a submission that has questions: one that is no object or empty breaks E003 or E004 alone.
        all_asked = parsed.where(top.startswith("OBJECT") & (top != "OBJECT<>")).select("sub_id").crossJoin(asked)
        broken.append(rule(all_asked.join(rows.select("sub_id", "qid"), ["sub_id", "qid"], "left_anti"), "E005"))
        broken.append(rule(rows.join(asked, "qid", "left_anti"), "E006"))
    return reduce(DataFrame.unionByName, broken)


def _summarised(broken: DataFrame) -> DataFrame:
    """Counts and examples; these are ranked before they are gathered, so that a rule broken everywhere gathers five."""
    each = broken.groupBy("sub_id", "code", "what").agg(F.count(F.lit(1)).alias("n"))
    totals = each.groupBy("sub_id", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("sub_id", "code").orderBy("what"))
    examples = each.where("what is not null").withColumn("place", place).where(F.col("place") <= EXAMPLES).groupBy("sub_id", "code").agg(F.array_sort(F.collect_list("what")).alias("examples"))
    titles = F.create_map(*[F.lit(x) for item in TITLES.items() for x in item])
    severity = F.when(F.col("code").startswith("E"), "error").otherwise("warning")
    return totals.join(examples, ["sub_id", "code"], "left").select("sub_id", severity.alias("severity"), "code", titles[F.col("code")].alias("title"), "n", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
