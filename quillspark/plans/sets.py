"""Queries on query sets, chunks, fallbacks, extractions and cleaned texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import graph, rank
from quillspark.plans import catalogue as c
from quillspark.sources import retrieval


def _sentences(spark, d):
    """(qid, texts): the sentences of every second question as its sub-questions, none for every fourth."""
    listed = F.regexp_extract_all("question", F.lit("[^.!?]+[.!?]"), F.lit(0))
    some = c.questions(spark, d).filter("qid % 4 <> 3")
    return some.select("qid", F.when(F.col("qid") % 2 == 0, listed).otherwise(F.array().cast("array<string>")).alias("texts"))


def query_set_rows(spark, d):
    """The question as row 0 and its sub-questions after it."""
    return rank.query_set(c.questions(spark, d), _sentences(spark, d)).select("qid", F.col("j").cast("int").alias("j"), F.md5("text").alias("text_md5"))


def reversed_paths(spark, d):
    return graph.reversed_path(_sentences(spark, d)).select("qid", F.md5(F.array_join("texts", "|")).alias("texts_md5"))


def chunk_texts(spark, d):
    """Passages as chunks, after their position and a colon."""
    chunks = retrieval.exported_chunks(c.passages(spark, d))
    return chunks.select("pid", F.md5(F.concat(F.col("pid").cast("string"), F.lit(":"), "chunk")).alias("text_md5"))


def fallback_order(spark, d):
    """The graph's passage order for every second query, and the dense one for those without seeds."""
    seeded = c.passage_order(spark, d).filter("qid % 100 = 0")
    both = graph.with_fallback(seeded.select("qid", "rank", "pid"), c.dense_topk(spark, d).select("qid", "rank", "pid"), c.vector_queries(spark, d).filter("j = 0 and qid % 100 = 0"))
    return both.select("qid", "rank", "pid")


def valid_extractions(spark, d):
    """Every turn as the JSON of an extraction with blank, missing and incomplete entries, of which the valid ones stay."""
    role, said = F.col("role"), F.col("text")
    none = F.lit(None).cast("string")
    entities = F.to_json(F.array(role, F.lit("  "), none, said))
    triples = F.to_json(F.array(F.array(role, F.lit("says"), said), F.array(role, said), F.array(role, F.lit(""), said), F.array(none, F.lit("x"), said)))
    rows = c._table(spark, d, "conversations").select("conv_id", "turn", graph.valid_entities(entities).alias("e"), graph.valid_triples(triples).alias("t"))
    return rows.select("conv_id", "turn", F.md5(F.array_join("e", "|")).alias("entities_md5"), F.md5(F.array_join(F.flatten("t"), "|")).alias("triples_md5"))


def cleaned_texts(spark, d):
    return c.spread_passages(spark, d).select("pid", F.md5(text.cleaned(F.col("text"))).alias("text_md5"))


QUERIES = {f.__name__: f for f in (query_set_rows, reversed_paths, chunk_texts, fallback_order, valid_extractions, cleaned_texts)}
_SETS = "s AS (SELECT item_id AS qid, text, CASE WHEN item_id % 2 = 0 THEN regexp_extract_all(text, '[^.!?]+[.!?]') ELSE []::VARCHAR[] END AS v FROM benchmark)"
_GOOD = "x IS NOT NULL AND trim(x) <> ''"

ORACLE_SQL = {
    "query_set_rows": f"WITH {_SETS} SELECT qid, CAST(unnest(range(0, len(v) + 1)) AS INTEGER) AS j, md5(unnest(list_concat([text], v))) AS text_md5 FROM s",
    "reversed_paths": f"WITH {_SETS} SELECT qid, md5(array_to_string(list_reverse(v), '|')) AS texts_md5 FROM s WHERE qid % 4 <> 3",
    "chunk_texts": "SELECT doc_id AS pid, md5(CAST(doc_id AS VARCHAR) || ':' || source || chr(10) || text) AS text_md5 FROM documents",
    "fallback_order": f"""SELECT qid, rank, pid FROM ({c.ORACLE_SQL['passage_order']}) AS a WHERE qid % 100 = 0
        UNION ALL SELECT qid, rank, pid FROM ({c.ORACLE_SQL['dense_topk']}) AS b WHERE qid % 100 <> 0""",
    "valid_extractions": f"""SELECT conv_id, turn, md5(array_to_string(list_filter([role, text], lambda x: {_GOOD}), '|')) AS entities_md5,
        md5(CASE WHEN {_GOOD.replace('x', 'role')} AND {_GOOD.replace('x', 'text')} THEN role || '|says|' || text ELSE '' END) AS triples_md5 FROM conversations""",
    "cleaned_texts": r"SELECT doc_id AS pid, md5(regexp_replace(trim(text, ' ,.?!;:'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents",
}
