"""Scoring and ranking.  A ranking is rows (qid, rank from 0, pid, score); ties go to the smaller pid."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import lexical
from quillspark.storage import grouped_files, kept, read_arrow, shared_files

#: Query vectors of a file, items that are scored at a time, scores at a time (items are fewer against a larger file), bytes of query files that a task keeps.
QUERY_BLOCK, ITEM_BLOCK, SCORES_AT_A_TIME, VECTOR_BYTES = 1024, 1024, 1 << 18, 16 << 20
#: Rows and characters of a side that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, broadcast if it is found to have at most ``rows`` rows that as text take at most ``size`` characters."""
    found = df.limit(rows + 1).select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.count("*").alias("rows"), F.sum("n").alias("size")).first()
    return F.broadcast(df) if found["rows"] <= rows and (found["size"] or 0) <= size else df


def top_k(scores: DataFrame, k: int, *group: str) -> DataFrame:
    """The k best of each group.  Spark cuts to k in each partition before the shuffle."""
    order = W.partitionBy(*(group or ("qid",))).orderBy(F.col("score").desc(), F.col("pid").asc())
    return scores.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision and fixed order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null, empty or zero."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def _best(scores: np.ndarray, keep: int) -> np.ndarray:
    """For each row of scores which columns are its ``keep`` best, of equal ones the first."""
    if keep >= scores.shape[1]:
        return np.ones(scores.shape, bool)
    least = np.partition(scores, -keep, axis=1)[:, -keep, None]
    more, equal = scores > least, scores == least
    return more | equal & (np.cumsum(equal, axis=1) <= keep - more.sum(1, keepdims=True))


def _pieces(items: int, vectors: int) -> list[slice]:
    """Items in pieces that make at most SCORES_AT_A_TIME scores with so many query vectors, or single ones."""
    step = max(1, SCORES_AT_A_TIME // max(vectors, 1))
    return [slice(low, min(low + step, items)) for low in range(0, items, step)]


class _Block:
    """A file of query vectors, and for each arm the scores that a task has to beat."""

    def __init__(self, rows: pa.Table):
        self.size = rows.nbytes
        self.j = rows.column(1).to_numpy().astype(np.int32)
        self.matrix = rows.column(2).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        qids = rows.column(0).combine_chunks()
        codes = qids.dictionary_encode().indices.fill_null(-1).to_numpy()
        self.firsts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        self.each, self.heads = qids, qids.take(pa.array(self.firsts))

    def scores(self, x: np.ndarray, arms: list[str], digits: int):
        """(arm, scores of all heads of the arm) for item vectors."""
        s = np.round(self.matrix @ x.T, digits)
        for arm in arms:
            if arm == "each":
                yield arm, s
            elif arm == "pooled":
                yield arm, s[self.firsts]
            elif arm == "max":
                yield arm, np.maximum.reduceat(s, self.firsts, axis=0)
            else:
                yield arm, np.round(np.add.reduceat(s, self.firsts, axis=0) / np.diff(np.append(self.firsts, len(s)))[:, None], digits + 2)


def dense_arms(items: DataFrame, queries: DataFrame, arms: list[str], keep: int | None = None, digits: int = 6) -> DataFrame:
    """(arm, qid, j, pid, score): inner products of all items (pid, embedding) with all query vectors (qid, j, embedding), for several arms at once.

    A stated query set against all rows: tasks write the query vectors to shared files, and tasks that read items score them against one file at a time.
    ``each`` scores every vector, ``pooled`` the first of a query's, ``max`` and ``mean`` take a query's vectors together (j is then 0).  With
    ``keep`` a task gives a row only if it is among the best so far of its query, so what is shuffled follows
    queries x tasks and not queries x items.  Rows without a vector have no score; qid may be of any type.
    """
    vectors = queries.select("qid", "j", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null")
    folder = grouped_files(vectors, "qid", ["j"], QUERY_BLOCK, "vectors")
    schema = T.StructType([T.StructField("arm", T.StringType()), T.StructField("qid", queries.schema["qid"].dataType), T.StructField("j", T.IntegerType()), T.StructField("pid", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        names, held, room = shared_files(folder), {}, VECTOR_BYTES
        least: dict[tuple, np.ndarray] = {}

        def block(name: str) -> _Block:
            nonlocal room
            if name in held:
                return held[name]
            made = _Block(read_arrow(f"{folder}/{name}"))
            if made.size <= room:
                held[name], room = made, room - made.size
            return made

        def rows(heads: pa.Array, j: np.ndarray, pids: np.ndarray, arm: str, s: np.ndarray, name: str) -> pa.RecordBatch | None:
            if keep is None:
                row, col = np.divmod(np.arange(s.size), s.shape[1])
            else:
                best = least.setdefault((name, arm), np.full((len(heads), keep), -np.inf))
                chosen = _best(s, keep) & (s >= best[:, :1])
                row, col = np.nonzero(chosen)
                if len(row):  # only queries with something new are sorted again
                    some = np.flatnonzero(chosen.any(axis=1))
                    both = np.concatenate([best[some], np.where(chosen[some], s[some], -np.inf)], axis=1)
                    best[some] = np.sort(np.partition(both, -keep, axis=1)[:, -keep:], axis=1)
            if not len(row):
                return None
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(arm, pa.string()), len(row)), heads.take(pa.array(row)), pa.array(j[row]), pa.array(pids[col]), pa.array(s[row, col])], ["arm", "qid", "j", "pid", "score"])

        for b in batches:
            for at in range(0, b.num_rows, ITEM_BLOCK):
                part = b.slice(at, ITEM_BLOCK).sort_by("pid")  # the first of equal scores is the smaller pid
                pids = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                for name in names:
                    q = block(name)
                    for some in _pieces(len(x), len(q.j)):
                        for arm, s in q.scores(x[some], arms, digits):
                            heads, j = (q.each, q.j) if arm == "each" else (q.heads, np.zeros(len(q.heads), np.int32))
                            made = rows(heads, j, pids[some], arm, s, name)
                            if made is not None:
                                yield made

    return items.select(F.col("pid").cast("long").alias("pid"), "embedding").filter("embedding is not null").mapInArrow(run, schema)


def dense_scores(items: DataFrame, queries: DataFrame, keep: int | None = None, combine: str | None = None, digits: int = 6) -> DataFrame:
    """(qid, j, pid, score) of one arm: all query vectors, or with ``combine`` (max or mean) a query's vectors taken together."""
    return dense_arms(items, queries, [combine or "each"], keep, digits).drop("arm")


def pooled(scores: DataFrame) -> DataFrame:
    """The question's own score (j = 0)."""
    return scores.filter("j = 0").select("qid", "pid", "score")


def sigma_max(scores: DataFrame) -> DataFrame:
    """The best score over a query set."""
    return scores.groupBy("qid", "pid").agg(F.max("score").alias("score"))


def fused_mean(scores: DataFrame, digits: int = 8) -> DataFrame:
    return scores.groupBy("qid", "pid").agg(F.round(F.avg("score"), digits).alias("score"))


def rrf(lists: DataFrame, k: int, constant: int = 60, digits: int = 9) -> DataFrame:
    """Reciprocal-rank fusion of (qid, list_no, rank, pid): ties to the item first seen, by list and then rank."""
    summed = lists.groupBy("qid", "pid").agg(F.round(F.sum(1.0 / (constant + F.col("rank") + 1)), digits).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "seen")
    return summed.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).select("qid", "rank", "pid", "score")


def fused_rrf(scores: DataFrame, k: int, depth: int) -> DataFrame:
    """Fusion of each sub-question's own ranking to ``depth``."""
    return rrf(top_k(scores, depth, "qid", "j").withColumnRenamed("j", "list_no"), k)


def words(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case words of two characters or more: ASCII and Latin-1 letters, digits, underscores."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9à-öø-ÿ_]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stopwords)) if stopwords else found


def unicode_words(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case words of two characters or more of any script."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stopwords)) if stopwords else found


def bm25(passages: DataFrame, queries: DataFrame, k: int, stopwords: list[str] | None = None, digits: int = 6, tokens=words, stems: bool = False) -> DataFrame:
    """BM25 of passages (pid, text) for queries (qid, question): idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    A query term counts as often as the query has it.  With ``stems`` both sides go by English stems.
    """
    return bm25_on(lexical.build(passages, tokens, stopwords, stems), queries, k, stopwords, digits, tokens, stems)


def bm25_on(index: DataFrame, queries: DataFrame, k: int, stopwords: list[str] | None = None, digits: int = 6, tokens=words, stems: bool = False) -> DataFrame:
    """The same on an index, which must know ``stopwords`` as its ``drop``."""
    best = top_k(lexical.search(index, queries, k, tokens, stopwords, stems, digits), k).select("qid", "rank", "pid", "score")
    return kept(best, "ranked")  # stored, so that joins know its size: the index's rows are paths, of which Spark would take it for small


def hybrid(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Fusion of two rankings, the first one's order winning ties."""
    return rrf(first.select("qid", F.lit(0).alias("list_no"), "rank", "pid").union(second.select("qid", F.lit(1).alias("list_no"), "rank", "pid")), k)


class PairScorer(Protocol):
    """A model that scores (question, passage) pairs; loaded once for a Python worker."""

    def score(self, questions: list[str], passages: list[str]) -> list[float]: ...


class OverlapScorer:
    """A deterministic stand-in for a cross-encoder: the share of the question's words that the passage has."""

    def score(self, questions: list[str], passages: list[str]) -> list[float]:
        sets = [[set(re.findall(r"[a-z0-9à-öø-ÿ_]{2,}", (t or "").lower())) for t in side] for side in (questions, passages)]
        return [round(len(q & p) / len(q), 6) if q else 0.0 for q, p in zip(*sets, strict=True)]


#: Tokens of a question and a passage that a pair scorer reads together.
JOINT_TOKENS = 384


def joint_cut(question: list, passage: list, limit: int) -> tuple[list, list]:
    """Both sides, cut at the end to ``limit`` together: the longer side goes first, sides that stay longer than half end up equal (the passage has the odd one)."""
    half = limit // 2
    q = min(len(question), max(half, limit - len(passage)))
    return question[:q], passage[: limit - q]


def words_of(t: str) -> list[tuple[int, int]]:
    """Places of a text's words: the stand-in for a model's tokens."""
    return [m.span() for m in re.finditer(r"\S+", t)]


def _cut_texts(question: str, passage: str, limit: int, tokens) -> tuple[str, str]:
    spans = tokens(question), tokens(passage)
    if len(spans[0]) + len(spans[1]) <= limit:
        return question, passage
    kept_spans = joint_cut(*spans, limit)
    return tuple(t[: s[-1][1]] if s else "" for t, s in zip((question, passage), kept_spans, strict=True))


def scored_pairs(pairs: DataFrame, make: Callable[[], PairScorer], batch: int = 64, limit: int | None = JOINT_TOKENS) -> DataFrame:
    """(qid, pid, score) of pairs (qid, pid, text, passage); ``make`` loads the model once for a task.

    Pairs are cut to ``limit`` tokens together, by the model's own ``tokens`` (a text's token places) if it has such, and go to the model in batches of like lengths.
    """
    schema = T.StructType([*pairs.select("qid", "pid").schema, T.StructField("score", T.DoubleType())])

    def run(batches):
        model = make()
        tokens = getattr(model, "tokens", words_of)
        for b in batches:
            texts = [(q or "", p or "") for q, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            if limit is not None:
                texts = [_cut_texts(q, p, limit, tokens) for q, p in texts]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i][0]) + len(texts[i][1]))
            scores = np.zeros(len(texts))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                scores[some] = model.score([texts[i][0] for i in some], [texts[i][1] for i in some])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["qid", "pid", "score"])

    return pairs.select("qid", "pid", "text", "passage").mapInArrow(run, schema)


class Encoder(Protocol):
    """A model that turns texts into unit vectors."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """A deterministic stand-in for a sentence encoder: signed hashed words, normalised."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dimensions] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def encoded(texts: DataFrame, make: Callable[[], Encoder], column: str = "text", batch: int = 32) -> DataFrame:
    """``texts`` with an embedding; ``make`` loads the model once for a task, which encodes batches of like lengths.  Null counts as empty."""
    schema = T.StructType([*texts.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        model = make()
        for b in batches:
            lines = [t or "" for t in b.column(column).to_pylist()]
            order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
            out: list = [None] * len(lines)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                for i, v in zip(some, model.encode([lines[i] for i in some]), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], schema.names)

    return texts.mapInArrow(run, schema)


def query_set(questions: DataFrame, subqs: DataFrame) -> DataFrame:
    """(qid, j, text): the question as j = 0, then its sub-questions (qid, texts); none where there are none."""
    both = questions.join(subqs, "qid", "left").select("qid", F.concat(F.array("question"), F.coalesce("texts", F.array().cast("array<string>"))).alias("t"))
    return both.select("qid", F.posexplode("t").alias("j", "text"))


def shuffled_views(views: DataFrame, donors: DataFrame) -> DataFrame:
    """Control: (qid, views) with each question's own first view and the further views of its donor (qid, donor)."""
    theirs = views.select(F.col("qid").alias("donor"), F.slice("views", 2, F.greatest(F.size("views") - 1, F.lit(0))).alias("_more"))
    own = donors.join(theirs, "donor").join(views.select("qid", F.slice("views", 1, 1).alias("_first")), "qid")
    return own.select("qid", F.concat("_first", "_more").alias("views"))


def overlap_score(question: Column, passage: Column) -> Column:
    """A lexical stand-in for a cross-encoder: the share of the question's words that the passage has."""
    q = F.array_distinct(words(question))
    return F.coalesce(F.round(F.size(F.array_intersect(q, words(passage))) / F.nullif(F.size(q), F.lit(0)), 6), F.lit(0.0))


def reranked(candidates: DataFrame, sets: DataFrame, passages: DataFrame, k: int, score=overlap_score, model: Callable[[], PairScorer] | None = None, limit: int | None = JOINT_TOKENS) -> DataFrame:
    """Candidates (qid, rank, pid) by the best score over the query set (qid, j, text), of an expression or, if given, of a
    model's, which reads ``limit`` tokens of a pair (None: all of both texts); a query without a set keeps its order."""
    texts = passages.select("pid", F.col("text").alias("passage"))
    pairs = candidates.join(sets, "qid").join(texts, "pid")
    each = scored_pairs(pairs, model, limit=limit) if model else pairs.select("qid", "pid", score(F.col("text"), F.col("passage")).alias("score"))
    scored = each.groupBy("qid", "pid").agg(F.max("score").alias("score"))
    asked = sets.select("qid").distinct()
    same = candidates.join(asked, "qid", "left_anti").filter(F.col("rank") < k).select("qid", "rank", "pid", F.lit(None).cast("double").alias("score"))
    return top_k(scored, k).select("qid", "rank", "pid", "score").union(same)


def multi_vector_cosine(rows: Column, vector: Column, mode: str = "plain") -> Column:
    """The best cosine over an array of vectors, 0 for none; normalized maps it to 0..1, relu and relu_sq cut it at 0 (choices: the source names the modes only)."""
    best = F.coalesce(F.array_max(F.transform(rows, lambda r: cosine(r, vector))), F.lit(0.0))
    positive = F.greatest(best, F.lit(0.0))
    return {"plain": best, "normalized": (best + 1) / 2, "relu": positive, "relu_sq": positive * positive}[mode]


def min_max(scores: DataFrame) -> DataFrame:
    """Scores of each query to 0..1; all 1 where they are equal (a choice: the source doesn't say)."""
    w = W.partitionBy("qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("score", F.when(high == low, 1.0).otherwise(F.round((F.col("score") - low) / (high - low), 6)))


def min_max_in_two_passes(scores: DataFrame) -> DataFrame:
    """``min_max`` of rows (qid, pid, score) that are too many to move: one pass adds up each query's bounds, as far as a task can, and a second meets them
    by a broadcast join where they are few enough, so only bounds are shuffled."""
    bounds = kept(scores.groupBy(F.col("qid").alias("_qid")).agg(F.min("score").alias("_low"), F.max("score").alias("_high")), "bounds")
    met = scores.join(bounded(bounds), F.col("qid").eqNullSafe(F.col("_qid")))
    return met.select(*(c for c in scores.columns if c != "score"), F.when(F.col("_high") == F.col("_low"), 1.0).otherwise(F.round((F.col("score") - F.col("_low")) / (F.col("_high") - F.col("_low")), 6)).alias("score"))


def edge_weights(edges: DataFrame, sims: DataFrame) -> DataFrame:
    """w x sim(src) x sim(dst); a node without a vector has similarity 0."""
    side = lambda name: sims.select(F.col("node").alias(name), F.col("sim").alias(f"_{name}"))
    return edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left").select("src", "dst", F.round(F.col("w") * F.coalesce("_src", F.lit(0.0)) * F.coalesce("_dst", F.lit(0.0)), 6).alias("w"))
