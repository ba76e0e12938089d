"""Queries on hybrid and reranked rankings, delta tables, statistics, reports and guards, with their SQL.

Document i has the vector i of embeddings, where there is one, and benchmark item i the vector i as its question's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import matching, metrics, rank, reports
from quillspark.plans import catalogue as c
from quillspark.plans import generated

DEPTH = 50


def _dense(spark, d, k):
    """(qid, rank, pid, score): documents by their vectors for each benchmark item's vector."""
    e = c._table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), "embedding")
    docs = e.join(c.passages(spark, d).select("pid"), "pid", "left_semi")
    asked = e.join(c.questions(spark, d).select(F.col("qid").alias("pid")), "pid", "left_semi").select(F.col("pid").alias("qid"), F.lit(0).alias("j"), "embedding")
    return c._ranked(rank.top_k(rank.dense_scores(docs, asked, k), k))


def hybrid_dense(spark, d):
    """BM25 and dense rankings to three times the depth, fused."""
    return c._ranked(rank.hybrid(rank.bm25(c.spread_passages(spark, d), c.questions(spark, d), 15), _dense(spark, d, 15), 5))


def rerank_dense(spark, d):
    """The dense ranking to DEPTH, reranked by a pair scorer that a task loads once and that reads both whole texts."""
    sets = c.questions(spark, d).select("qid", F.lit(0).alias("j"), F.col("question").alias("text"))
    return c._ranked(rank.reranked(_dense(spark, d, DEPTH), sets, c.passages(spark, d), 5, model=rank.OverlapScorer, limit=None))


def bm25_stemmed(spark, d):
    """BM25 with words of any script, English stopwords and English stems."""
    return c._ranked(rank.bm25(c.spread_passages(spark, d), c.questions(spark, d), 5, text.ENGLISH_STOPWORDS, tokens=rank.unicode_words, stems=True))


def multi_vector_cosine(spark, d):
    """The best cosine of a query's vectors to vector 1, and its two cut forms."""
    rows = c.vector_queries(spark, d).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "embedding"))), lambda x: x["embedding"]).alias("rows"))  # four vectors
    one = c._table(spark, d, "embeddings").filter("vec_id = 1").select(F.col("embedding").alias("v"))
    both = rows.crossJoin(F.broadcast(one))  # one row
    best = lambda mode: F.round(rank.multi_vector_cosine(F.col("rows"), F.col("v"), mode), 6).alias(mode)
    return both.select("qid", best("plain"), best("normalized"), best("relu"), best("relu_sq"))


def _covered(spark, d):
    return c.vector_queries(spark, d).filter("j = 0").filter((F.col("qid") / c.STEP).cast("long") % 2 == 0).select("qid", F.explode(F.array(F.lit("max"), F.lit("mean"))).alias("arm"))


def delta_sections(spark, d):
    """The full delta table without its intervals."""
    return metrics.full_delta_table(c.arm_recalls(spark, d), "pooled", _covered(spark, d)).select("section", "bucket", "arm", "k", "delta", "n")


def delta_intervals(spark, d):
    return metrics.full_delta_table(c.arm_recalls(spark, d), "pooled", _covered(spark, d))


def coverage_delta(spark, d):
    return metrics.coverage_delta(c.arm_recalls(spark, d), "pooled", _covered(spark, d))


def content_effect(spark, d):
    """How much more the best of a query set gains than the mean of it, the control."""
    return metrics.content_effect(metrics.delta_table(c.arm_recalls(spark, d), "pooled", "shape"), "mean")


def _parsed(spark, d):
    return generated._completions(spark, d).select("id", text.parsed_questions(F.col("t")).alias("texts"), F.when(F.col("id") % 7 == 0, "length").otherwise("stop").alias("finish_reason"))


def set_statistics(spark, d):
    return reports.set_statistics(_parsed(spark, d))


def _conversation_questions(spark, d):
    """Conversations as questions: a turn is a hop, its role the answer, every third turn without a gold passage."""
    rows = c._table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t"))
    hop = F.struct("turn", F.concat(F.lit("What of #"), (F.col("turn") % 4).cast("string"), F.lit(" "), F.translate("t", "#", " ")).alias("question"), F.coalesce("role", F.lit("")).alias("answer"), F.when(F.col("turn") % 3 > 0, F.col("turn")).alias("gold_pid"))
    grouped = rows.groupBy(F.col("conv_id").alias("qid")).agg(F.sort_array(F.collect_list(hop)).alias("hops"))
    gold = F.filter(F.array_distinct(F.transform("hops", lambda h: h["gold_pid"])), lambda x: x.isNotNull())
    return grouped.select("qid", "hops", gold.alias("gold"), (F.size("hops") > 3).alias("is_join"), F.concat((F.size("hops") % 3).cast("string"), F.lit("hop")).alias("shape"))


def ablation_sets(spark, d):
    return reports.ablation_sets(_conversation_questions(spark, d)).select("qid", "tag", F.md5(F.array_join("texts", "|")).alias("texts_md5"))


def unresolved_placeholders(spark, d):
    return reports.unresolved(reports.ablation_sets(_conversation_questions(spark, d)))


def shape_statistics(spark, d):
    return reports.shape_statistics(_conversation_questions(spark, d))


def hop_statistics(spark, d):
    return reports.hop_statistics(_conversation_questions(spark, d))


def first_passages(spark, d):
    """The first 100 passages by position: the limit is the feature."""
    return reports.first_by_position(c.passages(spark, d).withColumn("ord", F.col("pid")), 100).select("pid", F.md5("text").alias("text_md5"))


def _options(spark, d):
    """(tid, gold): each item's documents that hold it, as the alternatives of one gold passage."""
    return c.gold_containment(spark, d).groupBy(F.col("item_id").alias("tid")).agg(F.array(F.sort_array(F.collect_set("pid"))).alias("gold"))


def gold_statistics(spark, d):
    theirs = c.questions(spark, d).select(F.col("qid").alias("tid"))
    gold = _options(spark, d)
    return reports.gold_statistics(gold, theirs, theirs.join(gold, "tid", "left_anti"))


def unlocated_items(spark, d):
    """Benchmark items of at least the narrowest width that no document holds."""
    long = c.questions(spark, d).withColumnRenamed("qid", "item_id").filter(F.length(text.ascii_normalised(F.col("question"))) >= min(matching.WIDTHS))
    return reports.without_chunk(long.select("item_id"), c.gold_containment(spark, d))


def unmatched_ids(spark, d):
    matched = generated.match_qid(spark, d)
    return reports.unmatched(matched.select("tid"), matched).select("tid")


def _runs(spark, d):
    lists = lambda ranking, arm: metrics.as_lists(ranking).select(F.lit(arm).alias("arm"), "qid", F.col("ranked").alias("ids"))
    return lists(c.dense_topk(spark, d).filter(F.col("rank") < 4), "short").union(lists(c.dense_topk(spark, d), "long"))


def depth_warnings(spark, d):
    """Runs of one arm for each role: a conversation's list has as many ids as the role has turns in it."""
    turns = c._table(spark, d, "conversations").groupBy(F.coalesce("role", F.lit("")).alias("arm"), F.col("conv_id").alias("qid")).agg(F.sort_array(F.collect_list("turn")).alias("ids"))
    return reports.depth_warnings(turns, (2, 3, 5, 10, 20))


def same_granularity(spark, d):
    return reports.same_granularity(_runs(spark, d).filter("arm = 'long'"), c._table(spark, d, "embeddings"))


def text_joined_sets(spark, d):
    """Every second benchmark item's set, found by the normalised question; whether the match is good enough."""
    q = c.questions(spark, d)
    sets = q.filter("qid % 2 = 0").select(text.normalised("question").alias("qkey"), F.array("question").alias("texts")).dropDuplicates(["qkey"])
    return reports.checked_matches(matching.by_text(q, sets)).select("qid", F.size("texts").alias("n_texts"))


def mapped_documents(spark, d):
    """The BM25 ranking's texts as pids, of equal texts the last; every fifth text is one that no document has."""
    p = c.passages(spark, d)
    got = c.bm25_topk(spark, d).join(p.select("pid", "text"), "pid").select("qid", "rank", F.when(F.col("rank") == 4, "none of them").otherwise(F.col("text")).alias("text"))
    return matching.mapped_documents(got, p)


def scorable_questions(spark, d):
    """Items with gold that both rankings answer."""
    run = lambda ranking, arm: ranking.select(F.lit(arm).alias("arm"), "qid").distinct()
    gold = c.gold_containment(spark, d).select(F.col("item_id").alias("qid"))
    return matching.scorable(c.questions(spark, d).select("qid"), gold, run(c.bm25_topk(spark, d), "bm25").union(run(_dense(spark, d, 5), "dense")))


_SAME = [
    hybrid_dense, rerank_dense, bm25_stemmed, multi_vector_cosine, delta_sections, delta_intervals, coverage_delta, content_effect, set_statistics, ablation_sets,
    unresolved_placeholders, shape_statistics, hop_statistics, first_passages, gold_statistics, unlocated_items, unmatched_ids, depth_warnings, same_granularity,
    text_joined_sets, mapped_documents, scorable_questions,
]
QUERIES = {f.__name__: f for f in _SAME}

_DENSE = """
    dv AS (SELECT b.item_id AS qid, e.vec_id AS pid, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
           FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents))"""
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9à-öø-ÿ_]{{2,}}'))"
_ARMS = f"""{c._VECTORS}, z AS (SELECT qid, pid, score FROM s WHERE j = 0), tp AS ({c._TOP.format('z', c.K)}), tm AS ({c._TOP.format('smax', c.K)}), ta AS ({c._TOP.format('smean', c.K)}),
    rp AS ({c._RECALLS.format('tp')}), rm AS ({c._RECALLS.format('tm')}), ra AS ({c._RECALLS.format('ta')}),
    d AS (SELECT 'max' AS arm, rm.qid, rm.k, rm.shape, rm.n_hops, rm.h / nullif(rm.g, 0)::DOUBLE - rp.h / nullif(rp.g, 0)::DOUBLE AS delta FROM rm JOIN rp USING (qid, k)
          UNION ALL SELECT 'mean', ra.qid, ra.k, ra.shape, ra.n_hops, ra.h / nullif(ra.g, 0)::DOUBLE - rp.h / nullif(rp.g, 0)::DOUBLE FROM ra JOIN rp USING (qid, k)),
    dd AS (SELECT d.*, q.label FROM d JOIN q ON q.qid = d.qid AND q.j = 0 WHERE delta IS NOT NULL)"""
_HOPS = """
    h AS (SELECT conv_id AS qid, turn, 'What of #' || CAST(turn % 4 AS VARCHAR) || ' ' || replace(coalesce(text, ''), '#', ' ') AS question,
        coalesce(role, '') AS answer, CASE WHEN turn % 3 > 0 THEN turn END AS gold_pid,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn, 'What of #' || CAST(turn % 4 AS VARCHAR) || ' ' || replace(coalesce(text, ''), '#', ' '),
                     coalesce(role, '')) AS hop FROM conversations),
    n AS (SELECT qid, list(answer ORDER BY hop) AS answers FROM h GROUP BY ALL),
    r AS (SELECT h.qid, h.hop, h.question, CASE WHEN turn % 4 > 0 AND turn % 4 <= len(answers) THEN 'What of ' || answers[turn % 4] ELSE 'What of #' ||
        CAST(turn % 4 AS VARCHAR) END || ' ' || rest AS resolved
          FROM (SELECT *, substr(question, 12) AS rest FROM h) AS h JOIN n USING (qid))"""
_SETS = f"""WITH p AS ({generated.ORACLE_SQL["parsed_subquestions"]}), z AS (SELECT id, CASE WHEN questions = '' THEN 0 ELSE len(string_split(questions, '|')) END AS n, questions FROM p)"""
_KEY = r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({0})), 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"

ORACLE_SQL = {
    "hybrid_dense": f"""WITH {c._bm25_sql('x1', 15, False)}, {_DENSE}, x2 AS ({c._TOP.format('dv', 15)}), u AS (SELECT qid, 0 AS l, rank, pid FROM x1 UNION ALL SELECT qid, 1,
        rank, pid FROM x2), f AS (SELECT qid, pid, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score, min(l * 1000 + rank) AS seen FROM u GROUP BY ALL)
        SELECT qid, CAST(r - 1 AS INTEGER) AS rank, pid, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS r FROM f) AS
        x WHERE r <= 5""",
    "rerank_dense": f"""WITH {_DENSE}, t AS ({c._TOP.format('dv', DEPTH)}),
        w AS (SELECT t.qid, t.pid, {_WORDS.format('q.text')} AS qw, {_WORDS.format('p.text')} AS pw FROM t JOIN benchmark q ON q.item_id = t.qid JOIN documents p ON
            p.doc_id = t.pid),
        s AS (SELECT qid, pid, round(len(list_intersect(qw, pw)) / len(qw)::DOUBLE, 6) AS score FROM w) {c._TOP.format('s', 5)}""",
    "multi_vector_cosine": """WITH b AS (SELECT e.vec_id - e.vec_id % 50 AS qid, max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[]))) AS m FROM
        embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) AS o WHERE e.vec_id % 50 <= 3 GROUP BY ALL) SELECT qid, round(m, 6) AS plain,
        round((m + 1) / 2, 6) AS normalized, round(greatest(m, 0), 6) AS relu, round(greatest(m, 0) * greatest(m, 0), 6) AS relu_sq FROM b""",
    "delta_sections": f"""WITH {_ARMS}, x AS (SELECT 'all' AS section, 'all' AS bucket, * FROM dd UNION ALL SELECT 'depth x shape', CAST(n_hops AS VARCHAR) || 'hop-' || CASE WHEN label % 2 = 1 THEN 'join' ELSE 'chain' END, * FROM dd
        UNION ALL SELECT 'question type', CAST(shape AS VARCHAR), * FROM dd UNION ALL SELECT 'covered', arm, * FROM dd WHERE (qid // 50) % 2 = 0)
        SELECT section, bucket, arm, k, round(avg(delta), 6) AS delta, count(*) AS n FROM x GROUP BY ALL""",
    "coverage_delta": f"WITH {_ARMS} SELECT arm, k, round(avg(delta), 6) AS delta, count(*) AS n FROM dd WHERE (qid // 50) % 2 = 0 GROUP BY ALL",
    "content_effect": f"""WITH {_ARMS}, t AS (SELECT arm, k, CASE WHEN grouping(shape) = 0 THEN 'shape' ELSE 'overall' END AS section, CASE WHEN grouping(shape) = 0 THEN CAST(shape AS VARCHAR) ELSE '' END AS bucket, round(avg(delta), 6) AS delta FROM dd GROUP BY GROUPING SETS ((arm, k), (arm, k, shape)))
        SELECT a.arm, a.k, a.section, a.bucket, round(a.delta - b.delta, 6) AS effect FROM t a JOIN t b USING (k, section, bucket) WHERE a.arm <> 'mean' AND b.arm = 'mean'""",
    "set_statistics": f"""{_SETS} SELECT count(*) AS questions, count(*) FILTER (n > 0) AS non_empty, round(avg(n), 6) AS mean_size, CAST(min(n) AS INTEGER) AS min_size,
        CAST(max(n) AS INTEGER) AS max_size, count(*) FILTER (regexp_matches(questions, '#[0-9]')) AS leaks, count(*) FILTER (id % 7 = 0) AS truncated FROM z""",
    "ablation_sets": f"""WITH {_HOPS} SELECT qid, 'raw' AS tag, md5(string_agg(question, '|' ORDER BY hop)) AS texts_md5 FROM r GROUP BY qid UNION ALL SELECT qid, 'resolved',
        md5(string_agg(resolved, '|' ORDER BY hop)) FROM r GROUP BY qid""",
    "unresolved_placeholders": f"""WITH {_HOPS} SELECT 'raw' AS tag, count(*) FILTER (regexp_matches(question, '#[0-9]')) AS unresolved FROM r UNION ALL SELECT 'resolved', count(*)
        FILTER (regexp_matches(resolved, '#[0-9]')) FROM r""",
    "shape_statistics": f"""WITH {_HOPS}, t AS (SELECT qid, count(*) AS c, count(DISTINCT gold_pid) AS g FROM h GROUP BY ALL) SELECT CAST(c % 3 AS VARCHAR) || 'hop' AS shape,
        count(*) AS n, count(*) FILTER (c > 3) AS joins, round(avg(g), 6) AS mean_gold FROM t GROUP BY 1""",
    "hop_statistics": f"""WITH {_HOPS} SELECT CAST(hop AS INTEGER) AS hop, count(*) AS n, count(*) FILTER (regexp_matches(question, '#[0-9]')) AS placeholders, count(*) FILTER
        (gold_pid IS NULL) AS without_gold FROM h GROUP BY 1""",
    "first_passages": "SELECT doc_id AS pid, md5(text) AS text_md5 FROM documents WHERE doc_id < 100",
    "gold_statistics": f"""WITH {c._CONTAINED}, g AS (SELECT item_id, count(*) AS n FROM cont GROUP BY ALL) SELECT count(*) AS with_gold, round(coalesce(avg(n), 0), 6) AS
        mean_chunks, CASE WHEN count(*) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mean_passages, count(*) FILTER (n > 1) AS in_several, (SELECT count(*)
        FROM benchmark) AS questions, (SELECT count(*) FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM cont)) AS missing FROM g""",
    "unlocated_items": f"WITH {c._CONTAINED} SELECT item_id FROM p WHERE length(p) >= 40 AND item_id NOT IN (SELECT item_id FROM cont)",
    "unmatched_ids": f"SELECT tid FROM ({generated.ORACLE_SQL['match_qid']}) AS m WHERE qid IS NULL",
    "depth_warnings": """WITH n AS (SELECT coalesce(role, '') AS arm, conv_id, count(turn) AS n FROM conversations GROUP BY ALL), a AS (SELECT arm, CAST(max(n) AS INTEGER) AS
        depth FROM n GROUP BY ALL) SELECT arm, depth, k FROM a, (SELECT unnest([2, 3, 5, 10, 20]) AS k) AS ks WHERE k > depth""",
    "same_granularity": f"""WITH {c._VECTORS}, z AS (SELECT qid, pid, score FROM s WHERE j = 0), t AS ({c._TOP.format('z', c.K)}) SELECT max(pid) AS max_id, (SELECT count(*) FROM
        embeddings) AS passages, max(pid) >= 0.5 * (SELECT count(*) FROM embeddings) AS fine FROM t""",
    "text_joined_sets": f"""WITH k AS (SELECT item_id, {_KEY.format('text')} AS key FROM benchmark) SELECT item_id AS qid, CASE WHEN key IN (SELECT key FROM k WHERE item_id % 2 =
        0) THEN 1 ELSE 0 END AS n_texts FROM k""",
    "mapped_documents": f"""WITH {c._bm25_sql('b', 5, False)} SELECT b.qid, b.rank, CASE WHEN b.rank = 4 THEN -1 ELSE (SELECT max(x.doc_id) FROM documents x WHERE x.text =
        p.text) END AS pid FROM b JOIN documents p ON p.doc_id = b.pid""",
    "scorable_questions": f"""WITH {c._CONTAINED}, {c._bm25_sql('b', 5, False)}, {_DENSE} SELECT item_id AS qid FROM benchmark WHERE item_id IN (SELECT item_id FROM cont) AND
        item_id IN (SELECT qid FROM b) AND item_id IN (SELECT qid FROM dv)""",
}
