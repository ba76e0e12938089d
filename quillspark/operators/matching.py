"""Joins that tie ids, texts and passages of different sources together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import ascii_normalised, normalised
from quillspark.operators.rank import bounded
from quillspark.operators.substrings import occurrences
from quillspark.storage import kept

#: Prefix lengths, widest first, that locate a gold passage in chunks; shorter passages never match.
WIDTHS = (90, 60, 40)


def passage_index(passages: DataFrame) -> DataFrame:
    """key -> pid; of equal (title, text) the last pid."""
    return passages.groupBy("key").agg(F.max("pid").alias("pid"))


def title_counts(passages: DataFrame) -> DataFrame:
    """title -> the number of its pids, and the first; no list of them is made."""
    return passages.groupBy("title").agg(F.countDistinct("pid").cast("int").alias("n_pids"), F.min("pid").alias("first_pid"))


def by_text(queries: DataFrame, sets: DataFrame) -> DataFrame:
    """Queries (qid, question) with the texts of the query set (qkey, texts) of their normalised question; no texts where there is none."""
    keyed = queries.withColumn("qkey", normalised("question"))
    return keyed.join(sets.select("qkey", "texts"), "qkey", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def earlier_step(subjects: Column, objects: Column, i: Column) -> Column:
    """The first step before step i (from 1) whose object is step i's subject, from 1; null if none."""
    return F.nullif(F.array_position(F.slice(objects, 1, i - 1), F.element_at(subjects, i)), F.lit(0))


def bridge_question(evidence: Column, subjects: Column, objects: Column, i: Column) -> Column:
    """The question of step i (from 1)."""
    label = F.coalesce(F.concat(F.lit("#"), earlier_step(subjects, objects, i).cast("string")), F.element_at(evidence, 1))
    return F.concat(F.lit("What is the "), F.element_at(evidence, 2), F.lit(" of "), label, F.lit("?"))


def bridge_hops(rows: DataFrame) -> DataFrame:
    """(qid, hop, question, answer) from evidences, an array of [subject, relation, object]; a bridge subject is #N."""
    part = lambda k: F.transform("evidences", lambda e: F.element_at(e, k))
    steps = rows.select("qid", "evidences", part(1).alias("s"), part(3).alias("o"), F.posexplode("evidences").alias("p", "e"))
    return steps.select("qid", (F.col("p") + 1).alias("hop"), bridge_question(F.col("e"), F.col("s"), F.col("o"), F.col("p") + 1).alias("question"), F.element_at("e", 3).alias("answer"))


def matched_ids(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """(tid, qid): the id itself, else what follows its first underscore, where we know it; else null.  Two equi-joins."""
    known = bounded(ours.select("qid").distinct())
    tail = F.when(F.contains("tid", F.lit("_")), F.substr("tid", F.instr("tid", "_") + 1))
    return (
        theirs.select("tid", tail.alias("tail"))
        .join(known.select(F.col("qid").alias("same"), F.lit(True).alias("a")), F.col("tid") == F.col("same"), "left")
        .join(known.select(F.col("qid").alias("after"), F.lit(True).alias("b")), F.col("tail") == F.col("after"), "left")
        .select("tid", F.coalesce("same", "after").alias("qid"))
    )


def rekeyed(sets: DataFrame) -> DataFrame:
    """(qkey, texts, n_sets): the last set by ``ord`` for each key, and how many different sets the key had; empty sets don't count."""
    return sets.filter(F.coalesce(F.size("texts"), F.lit(0)) > 0).groupBy("qkey").agg(F.max_by("texts", "ord").alias("texts"), F.countDistinct("texts").alias("n_sets"))


def contained(passages: DataFrame, chunks: DataFrame, widths=WIDTHS) -> DataFrame:
    """(item_id, pid): chunks (pid, text) that hold the start of an item (item_id, text) at the widest width that occurs anywhere.

    The starts of all items are patterns of automata, with which one pass goes over the chunks' normalised texts.
    """
    norm = ascii_normalised(F.col("text"))
    cut = F.array(*(F.when(F.length("p") >= w, F.struct(F.lit(w).alias("width"), F.substring("p", 1, w).alias("pattern"))) for w in widths))
    probes = passages.select("item_id", norm.alias("p")).filter(F.length("p") >= min(widths))
    probes = probes.select("item_id", F.explode(F.filter(cut, lambda x: x.isNotNull())).alias("x")).select("item_id", "x.*")
    hits = occurrences(chunks.select("pid", norm), probes.select("pattern")).select(F.col("id").alias("pid"), "pattern")
    found = kept(probes.join(hits, "pattern").select("item_id", "width", "pid").distinct(), "contained")
    best = found.groupBy("item_id").agg(F.max("width").alias("width"))
    return found.join(best, ["item_id", "width"]).select("item_id", "pid").distinct()


def scorable(questions: DataFrame, gold: DataFrame, runs: DataFrame) -> DataFrame:
    """Questions with gold that every arm of the runs (arm, qid) answers."""
    arms = runs.select("arm").distinct().agg(F.count("*").alias("arms"))
    full = runs.groupBy("qid").agg(F.countDistinct("arm").alias("n")).crossJoin(F.broadcast(arms)).filter("n = arms")
    return questions.join(gold, "qid", "left_semi").join(full, "qid", "left_semi")


def mapped_documents(retrieved: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, rank, pid): document texts as pids of equal texts (the last), -1 where there is none."""
    index = passages.groupBy("text").agg(F.max("pid").alias("pid"))
    return retrieved.join(index, "text", "left").select("qid", "rank", F.coalesce("pid", F.lit(-1)).alias("pid"))
