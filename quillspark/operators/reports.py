"""Statistics of question sets, query sets and gold mappings, and the guards that keep a broken run from looking like a result."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import has_placeholder, resolved


class JoinFailure(ValueError):
    """No question matched a query set."""


def first_by_position(rows: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n rows by position; a filter that reaches the scan, where ``limit`` would take any rows."""
    return rows.filter(F.col(order) < n)


def covered(sets: DataFrame) -> DataFrame:
    """Query sets (qid, texts) with at least one text."""
    return sets.filter(F.coalesce(F.size("texts"), F.lit(0)) > 0)


def ablation_sets(questions: DataFrame) -> DataFrame:
    """(qid, tag, texts): the hops' questions as they are (raw) and with answers put in (resolved).  questions: qid, hops of question and answer."""
    answers = F.transform("hops", lambda h: h["answer"])
    raw = F.transform("hops", lambda h: h["question"])
    done = F.transform("hops", lambda h: resolved(h["question"], answers))
    both = F.array(F.struct(F.lit("raw").alias("tag"), raw.alias("texts")), F.struct(F.lit("resolved").alias("tag"), done.alias("texts")))
    return questions.select("qid", F.explode(both).alias("x")).select("qid", "x.*")


def unresolved(sets: DataFrame) -> DataFrame:
    """For each tag, how many texts still hold a placeholder."""
    return sets.select("tag", F.explode("texts").alias("t")).groupBy("tag").agg(F.count_if(has_placeholder(F.col("t"))).alias("unresolved"))


def set_statistics(sets: DataFrame) -> DataFrame:
    """One row about parsed query sets (qid, texts, finish_reason): sizes, empty ones, those with a placeholder and truncated completions."""
    size = F.coalesce(F.size("texts"), F.lit(0))
    return sets.agg(
        F.count("*").alias("questions"),
        F.count_if(size > 0).alias("non_empty"),
        F.round(F.avg(size), 6).alias("mean_size"),
        F.coalesce(F.min(size), F.lit(0)).alias("min_size"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_size"),
        F.count_if(F.exists("texts", has_placeholder)).alias("leaks"),
        F.count_if(F.col("finish_reason") == "length").alias("truncated"),
    )


def shape_statistics(questions: DataFrame) -> DataFrame:
    """For each shape the number of questions, of joins and the mean number of gold passages."""
    return questions.groupBy("shape").agg(F.count("*").alias("n"), F.count_if("is_join").alias("joins"), F.round(F.avg(F.size("gold")), 6).alias("mean_gold"))


def hop_statistics(questions: DataFrame) -> DataFrame:
    """For each hop position how many questions have one, with a placeholder, and without a resolved gold passage."""
    each = questions.select(F.posexplode("hops").alias("p", "h"))
    return each.groupBy((F.col("p") + 1).alias("hop")).agg(F.count("*").alias("n"), F.count_if(has_placeholder(F.col("h.question"))).alias("placeholders"), F.count_if(F.col("h.gold_pid").isNull()).alias("without_gold"))


def gold_statistics(gold: DataFrame, theirs: DataFrame, missing: DataFrame) -> DataFrame:
    """One row about a gold mapping (tid, gold of alternatives): questions with gold of all of theirs, ids that we don't know, mean
    distinct chunks and mean gold passages of a question, passages with several chunks."""
    mapped = gold.agg(
        F.count("*").alias("with_gold"),
        F.round(F.coalesce(F.avg(F.size(F.array_distinct(F.flatten("gold")))), F.lit(0.0)), 6).alias("mean_chunks"),
        F.round(F.coalesce(F.avg(F.size("gold")), F.lit(0.0)), 6).alias("mean_passages"),
        F.coalesce(F.sum(F.size(F.filter("gold", lambda o: F.size(o) > 1))), F.lit(0)).alias("in_several"),
    )
    counts = theirs.agg(F.count("*").alias("questions")).crossJoin(missing.agg(F.count("*").alias("missing")))
    return mapped.crossJoin(counts)  # one row each


def unmatched(theirs: DataFrame, matched: DataFrame) -> DataFrame:
    """Their ids (tid) without a question of ours; matched: tid, qid."""
    return theirs.join(matched.filter("qid IS NOT NULL"), "tid", "left_anti")


def uncovered(questions: DataFrame, sets: DataFrame) -> DataFrame:
    """Questions without a text in the query sets."""
    return questions.join(covered(sets), "qid", "left_anti")


def without_chunk(gold_passages: DataFrame, located: DataFrame) -> DataFrame:
    """Gold passages (item_id) that no chunk holds; located: item_id, pid."""
    return gold_passages.join(located, "item_id", "left_anti")


def depth_warnings(runs: DataFrame, ks=(2, 5, 10)) -> DataFrame:
    """(arm, depth, k): depths k beyond the longest list (arm, ids) of an arm, whose recall is really that at its depth."""
    depth = runs.groupBy("arm").agg(F.coalesce(F.max(F.size("ids")), F.lit(0)).alias("depth"))
    return depth.select("arm", "depth", F.explode(F.array(*map(F.lit, ks))).alias("k")).filter("k > depth")


def same_granularity(baseline: DataFrame, passages: DataFrame) -> DataFrame:
    """One row (max_id, passages, fine): whether the ids of a run (ids) reach half of the corpus, so that it ranks our passages."""
    top = baseline.agg(F.coalesce(F.max(F.array_max("ids")), F.lit(0)).alias("max_id"))
    return top.crossJoin(passages.agg(F.count("*").alias("passages"))).withColumn("fine", F.col("max_id") >= F.col("passages") * 0.5)  # one row each


def match_level(matched: Column) -> Column:
    """failed without any match, diluted under half, else good.  matched: one true or false for each question."""
    hits = F.count_if(matched)
    return F.when(hits == 0, "failed").when(hits < F.floor(F.count("*") / 2), "diluted").otherwise("good")


def checked_matches(queries: DataFrame) -> DataFrame:
    """Queries with texts after a join, or JoinFailure if none has any; a warning if under half have."""
    has = F.coalesce(F.size("texts"), F.lit(0)) > 0
    level = queries.agg(match_level(has)).first()[0]
    if level == "failed":
        raise JoinFailure("no question matched a query set")
    if level == "diluted":
        warnings.warn("under half of the questions matched a query set", stacklevel=2)
    return queries
