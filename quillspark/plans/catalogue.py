"""The named queries of the library on the given tables, each with its SQL where SQL can express it.

documents are the passages (pid = doc_id, title = source), benchmark the questions.  In embeddings every vector
whose id is divisible by 50 is a query with the three that follow as its sub-questions; these four aren't
candidates for it, and its gold are the other vectors of its label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import graph, lexical, matching, metrics, ordered, rank
from quillspark.storage import kept, spread_out

FLAGSHIP = "recall_by_bucket"
STEP, SUBQUESTIONS, K = 50, 3, 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pid"), F.col("source").alias("title"), "text")


def spread_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages for work on their whole texts, on all cores."""
    return spread_out(passages(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, j, embedding, label): the query vector as j = 0 and its sub-questions."""
    e = _table(spark, sf_dir, "embeddings")
    return e.withColumn("j", (F.col("vec_id") % STEP).cast("int")).filter(F.col("j") <= SUBQUESTIONS).select((F.col("vec_id") - F.col("j")).alias("qid"), "j", "embedding", "label")


def candidates(scores: DataFrame) -> DataFrame:
    return scores.filter(~F.col("pid").between(F.col("qid"), F.col("qid") + SUBQUESTIONS))


def vector_scores(spark: SparkSession, sf_dir: str, keep: int | None = None, combine: str | None = None, sub: bool = True) -> DataFrame:
    """Scores of the candidates; with ``keep`` the best that each batch has to give, those that aren't candidates on top."""
    items = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), "embedding")
    asked = vector_queries(spark, sf_dir)
    return candidates(rank.dense_scores(items, asked if sub else asked.filter("j = 0"), keep and keep + SUBQUESTIONS + 1, combine))


def vector_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, label, n_gold, shape, n_hops): how many candidates have the query's label, counted without listing them."""
    q = vector_queries(spark, sf_dir)
    own = q.groupBy("qid").agg(F.max(F.when(F.col("j") == 0, F.col("label"))).alias("label"), F.collect_list("label").alias("own"))  # four at most
    sizes = _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    n = F.col("n") - F.size(F.filter("own", lambda x: x == F.col("label")))
    return own.join(sizes, "label").select("qid", "label", n.alias("n_gold"), (F.col("label") % 3).alias("shape"), (F.col("label") % 4 + 1).alias("n_hops"), (F.col("label") % 2 == 1).alias("is_join"))


def gold_ranks(spark: SparkSession, sf_dir: str, ranking: DataFrame) -> DataFrame:
    """The rows of a ranking whose item has the query's label."""
    labels = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), "label")
    asked = vector_queries(spark, sf_dir).filter("j = 0").select("qid", F.col("label").alias("wanted"))
    return ranking.join(labels, "pid").join(asked, "qid").filter("label = wanted").drop("label", "wanted")


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, qid, rank, pid, score) of the pooled, best and mean rankings, from one pass over the items."""
    items = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), "embedding")
    scores = candidates(rank.dense_arms(items, vector_queries(spark, sf_dir), ["pooled", "max", "mean"], K + SUBQUESTIONS + 1))
    return kept(rank.top_k(scores.drop("j"), K, "arm", "qid"), "arms")


def arm_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, hits = vector_gold(spark, sf_dir), gold_ranks(spark, sf_dir, arms(spark, sf_dir))
    named = gold.withColumn("arm", F.explode(F.array(*map(F.lit, ("pooled", "max", "mean")))))
    return metrics.per_query_hits(named, hits, by=("arm",))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("int").alias("rank"), "pid", "score")


# ---- passages and text

def passage_identity(spark, d):
    p = passages(spark, d).withColumn("key", text.identity(F.col("title"), F.col("text")))
    return matching.passage_index(p)


def title_lookup(spark, d):
    return matching.title_counts(passages(spark, d))


def corpus_stats(spark, d):
    p = spread_passages(spark, d)
    return p.agg(F.count("*").alias("passages"), F.sum(text.word_count(F.col("text"))).alias("words"), F.sum(text.sentence_estimate(F.col("text"))).alias("sentences"), F.countDistinct("title").alias("titles"), F.count_if(text.has_placeholder(F.col("text"))).alias("placeholders"))


def norm_ascii(spark, d):
    return spread_passages(spark, d).select("pid", F.md5(text.ascii_normalised(F.col("text"))).alias("norm_md5"))


def norm_question(spark, d):
    return spread_passages(spark, d).select("pid", F.md5(text.normalised("text")).alias("key_md5"))


def content_counts(spark, d):
    return spread_passages(spark, d).select("pid", text.content_words(F.col("text")).alias("content"), F.size(text.entity_spans(F.col("text"))).alias("entities"))


def gold_containment(spark, d):
    items = questions(spark, d).select(F.col("qid").alias("item_id"), F.col("question").alias("text"))
    return matching.contained(items, spread_passages(spark, d).select("pid", "text"))


# ---- rankings

def bm25_topk(spark, d):
    return _ranked(rank.bm25(spread_passages(spark, d), questions(spark, d), 5))


def hybrid_rrf(spark, d):
    """BM25 with and without stopwords, from one index."""
    q, index = questions(spark, d), lexical.build(spread_passages(spark, d), rank.words, text.STOPWORDS)
    return _ranked(rank.hybrid(rank.bm25_on(index, q, 15), rank.bm25_on(index, q, 15, text.STOPWORDS), 5))


def rerank_overlap(spark, d):
    q = questions(spark, d)
    first = rank.bm25(spread_passages(spark, d), q, 20)
    return _ranked(rank.reranked(first, q.select("qid", F.lit(0).alias("j"), F.col("question").alias("text")), passages(spark, d), 5))


def dense_topk(spark, d):
    return _ranked(rank.top_k(vector_scores(spark, d, K, sub=False), K))


def sigma_max_topk(spark, d):
    return _ranked(rank.top_k(vector_scores(spark, d, K, "max"), K))


def fusion_mean(spark, d):
    return _ranked(rank.top_k(vector_scores(spark, d, K, "mean"), K))


def fusion_rrf(spark, d):
    return _ranked(rank.fused_rrf(vector_scores(spark, d, 3 * K), K, 3 * K))


def fact_minmax(spark, d):
    return rank.min_max_in_two_passes(vector_scores(spark, d, combine="max").select("qid", "pid", "score"))


# ---- metrics

def recall_by_bucket(spark, d):
    best = rank.top_k(vector_scores(spark, d, K, "max"), K)
    return metrics.report(metrics.per_query_hits(vector_gold(spark, d), gold_ranks(spark, d, best)), "shape", "n_hops")


def paired_delta(spark, d):
    return metrics.delta_table(arm_recalls(spark, d), "pooled", "shape").select("arm", "k", F.when(F.col("section") == "overall", "all").otherwise(F.col("bucket")).alias("bucket"), "delta", "n")


def best_over_views(spark, d):
    """Recall when each query takes its best sub-question's own ranking."""
    top = rank.top_k(vector_scores(spark, d, K), K, "qid", "j")
    hits = gold_ranks(spark, d, top).groupBy("qid", "j").agg(F.count("*").alias("h")).groupBy("qid").agg(F.max("h").alias("h"))
    found = vector_gold(spark, d).join(hits, "qid", "left")
    return found.select("qid", F.round(F.coalesce("h", F.lit(0)) / F.nullif(F.col("n_gold"), F.lit(0)), 6).alias("recall"))


def per_hop_recall(spark, d):
    """Each sub-question's own gold: the first candidate of its label."""
    q = vector_queries(spark, d).filter("j > 0")
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), "label")
    few = e.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy("pid"))).filter(F.col("r") <= SUBQUESTIONS + 2).drop("r")  # at most four aren't candidates
    hops = candidates(q.join(few, "label")).groupBy("qid", F.col("j").alias("hop")).agg(F.min("pid").alias("gold_pid"))
    return metrics.hop_hits(hops, rank.top_k(vector_scores(spark, d, K, "max"), K))


def option_recall(spark, d):
    """Gold passages by containment, each with all documents that hold it as alternatives."""
    options = gold_containment(spark, d).groupBy("item_id").agg(F.array(F.sort_array(F.collect_set("pid"))).alias("options"))
    lists = metrics.as_lists(bm25_topk(spark, d))
    q = questions(spark, d).join(options, F.col("qid") == F.col("item_id"), "left").join(lists, "qid", "left")
    empty = F.array().cast("array<bigint>")
    return q.select("qid", metrics.option_recall(F.coalesce("options", F.array().cast("array<array<bigint>>")), F.coalesce("ranked", empty), 5).alias("recall"))


def bootstrap_ci(spark, d):
    rows = metrics.paired(arm_recalls(spark, d), "pooled").select("arm", "k", F.col("qid").alias("ord"), F.col("delta").alias("value"))
    return metrics.intervals(rows, "arm", "k")


# ---- graphs

def edge_weight(spark, d):
    """Edges from each query vector to its best candidates, weighted by both ends' cosine to vector 0."""
    e = _table(spark, d, "embeddings")
    zero = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    sims = e.crossJoin(F.broadcast(zero)).select(F.col("vec_id").alias("node"), F.round(rank.cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))  # one row
    edges = dense_topk(spark, d).select(F.col("qid").alias("src"), F.col("pid").alias("dst"), F.col("score").alias("w"))
    return rank.edge_weights(edges, sims)


def pagerank_vectors(spark, d):
    top = dense_topk(spark, d)
    edges = top.filter("score > 0").select(F.col("qid").alias("src"), F.col("pid").alias("dst"), F.col("score").alias("w"))
    reset = vector_queries(spark, d).filter("j = 0").select(F.lit(0).alias("qid"), F.col("qid").alias("node"), (F.col("label") + 1).cast("double").alias("weight"))
    return graph.pagerank(edges, reset, rounds=3).select("node", F.round("score", 6).alias("score"))


def _mentions(spark, d) -> DataFrame:
    """(entity, sentence): capitalised spans of the benchmark's sentences."""
    s = questions(spark, d).select("qid", F.posexplode(F.split("question", r"(?<=[.!?])\s")).alias("p", "s"))
    return s.select((F.col("qid") * 1000 + F.col("p")).alias("sentence"), F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(r"([A-Za-z]{2,})"), F.lit(1)))).alias("entity"))


def entity_spread(spark, d):
    """Activation from the first word of each question over sentences that share words."""
    m = _mentions(spark, d)
    seeds = questions(spark, d).select("qid", F.regexp_extract("question", r"([A-Za-z]{2,})", 1).alias("entity"), F.lit(1.0).alias("score")).filter("entity <> ''")
    short = m.groupBy("sentence").agg(F.round(0.5 + 0.5 / F.count("*"), 6).alias("gate"))
    return graph.spread(seeds, m, lambda pairs, tier: pairs.join(short, "sentence"), threshold=0.5, rounds=2)


def sigma_spread(spark, d):
    """Activation along a path of sub-questions: vectors are sentences that mention their label and one of 97 more entities, a query's label is
    its seed, and each tier is gated by the question and one sub-question."""
    e = _table(spark, d, "embeddings")
    named = F.array(F.concat(F.lit("label "), F.col("label").cast("string")), F.concat(F.lit("part "), (F.col("vec_id") % 97).cast("string")))
    mentions = e.select(F.explode(named).alias("entity"), F.col("vec_id").alias("sentence"))
    q = vector_queries(spark, d)
    seeds = q.filter("j = 0").select("qid", F.concat(F.lit("label "), F.col("label").cast("string")).alias("entity"), F.lit(1.0).alias("score"))
    gates = graph.vector_gates(e.select(F.col("vec_id").alias("sentence"), "embedding"), q, window=0)
    return graph.spread(seeds, mentions, gates, threshold=0.05, per_entity=3, rounds=2)


def passage_order(spark, d):
    """Vectors as passages, by PageRank over what they mention: from the entities that the spread activates, and the best vectors, those of the query's label with a bonus."""
    e, top = _table(spark, d, "embeddings"), dense_topk(spark, d)
    named = F.array(F.concat(F.lit("e:label "), F.col("label").cast("string")), F.concat(F.lit("e:part "), (F.col("vec_id") % 97).cast("string")))
    edges = e.select(F.explode(named).alias("src"), F.concat(F.lit("p:"), F.col("vec_id").cast("string")).alias("dst"), F.lit(1.0).alias("w"))
    bonus = gold_ranks(spark, d, top).select("qid", "pid", F.lit(0.5).alias("bonus"))
    return _ranked(graph.passage_order(edges, sigma_spread(spark, d), graph.passage_weights(top, bonus), K, rounds=2))


def passage_bonus(spark, d):
    """What the activated words of the benchmark's questions add to the documents that hold them, as parts of words too."""
    return graph.passage_bonus(entity_spread(spark, d), spread_passages(spark, d).select("pid", "text"))


def tier_histogram(spark, d):
    return graph.tier_report(entity_spread(spark, d), questions(spark, d).select("qid", F.col("question").alias("text")))


def rekey_collisions(spark, d):
    """Documents as query sets of their own text, keyed by source: the last set wins."""
    sets = passages(spark, d).select(F.col("title").alias("qkey"), F.col("pid").alias("ord"), F.array(F.md5("text")).alias("texts"))
    return matching.rekeyed(sets).select("qkey", F.element_at("texts", 1).alias("last"), F.col("n_sets").alias("n_sets"))


def views_regex(spark, d):
    return questions(spark, d).select("qid", F.posexplode(text.views("question")).alias("j", "view"))


def _donors(spark, d) -> DataFrame:
    """(qid, donor): every question and the one whose views it gets, the next of all by a keyed hash, the first after the last."""
    q = questions(spark, d).select("qid", F.md5(F.concat(F.lit("views-0-"), F.col("qid").cast("string"))).alias("h"))
    return ordered.with_next(q, ["h", "qid"], "qid", "donor", cyclic=True).select("qid", "donor")


def views_donors(spark, d):
    return _donors(spark, d)


def views_shuffled(spark, d):
    """Control: every question keeps itself as view 0 and gets the further views, here the sentences, of another."""
    listed = questions(spark, d).select("qid", F.concat(F.array("question"), F.regexp_extract_all("question", F.lit("[^.!?]+[.!?]"), F.lit(0))).alias("views"))
    return rank.shuffled_views(listed, _donors(spark, d)).select("qid", F.size("views").alias("n_views"), F.md5(F.array_join("views", "|")).alias("views_md5"))


def offset_lookup(spark, d):
    """The documents, normalised, as one long text with a space after each: in which document lies the start and the end of each benchmark item that one holds?"""
    norm = text.ascii_normalised(F.col("text"))
    sizes = spread_passages(spark, d).select("pid", (F.length(norm) + 1).cast("long").alias("size"))
    starts = kept(ordered.running(sizes, ["pid"], "size", "at").select("pid", (F.col("at") - F.col("size")).alias("at")), "starts")
    items = questions(spark, d).select(F.col("qid").alias("item_id"), text.ascii_normalised(F.col("question")).alias("item"))
    held = gold_containment(spark, d).join(items, "item_id").join(passages(spark, d).select("pid", norm.alias("norm")), "pid").join(starts, "pid")
    first = F.col("at") + F.instr("norm", F.substring("item", 1, 40)) - 1
    asked = held.select("item_id", F.explode(F.array(first, first + F.length("item"))).alias("at"))
    return ordered.as_of(asked, starts, "at", "pid").select("item_id", F.col("at").alias("place"), "pid")


_SAME = [
    passage_identity, title_lookup, corpus_stats, norm_ascii, norm_question, content_counts, gold_containment, bm25_topk, hybrid_rrf, rerank_overlap,
    dense_topk, sigma_max_topk, fusion_mean, fusion_rrf, fact_minmax, recall_by_bucket, paired_delta, best_over_views, per_hop_recall, option_recall, bootstrap_ci,
    edge_weight, pagerank_vectors, entity_spread, sigma_spread, passage_order, tier_histogram, passage_bonus, rekey_collisions, views_regex, views_donors, views_shuffled, offset_lookup,
]
QUERIES = {f.__name__: f for f in _SAME}

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_VECTORS = """
    q AS (SELECT vec_id - vec_id % 50 AS qid, CAST(vec_id % 50 AS INTEGER) AS j, embedding, label FROM embeddings WHERE vec_id % 50 <= 3),
    s AS (SELECT q.qid, q.j, e.vec_id AS pid, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
          FROM q, embeddings e WHERE e.vec_id NOT BETWEEN q.qid AND q.qid + 3),
    smax AS (SELECT qid, pid, max(score) AS score FROM s GROUP BY ALL),
    smean AS (SELECT qid, pid, round(avg(score), 8) AS score FROM s GROUP BY ALL),
    gold AS (SELECT q.qid, e.vec_id AS pid FROM q JOIN embeddings e ON e.label = q.label WHERE q.j = 0 AND e.vec_id NOT BETWEEN q.qid AND q.qid + 3),
    qs AS (SELECT qid, label % 3 AS shape, label % 4 + 1 AS n_hops FROM q WHERE j = 0),
    ks AS (SELECT unnest([2, 5, 10]) AS k)"""
_TOP = "SELECT qid, CAST(r - 1 AS INTEGER) AS rank, pid, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS r FROM {0}) AS x WHERE r <= {1}"
_RECALLS = "SELECT qs.*, ks.k, (SELECT count(*) FROM gold WHERE gold.qid = qs.qid) AS g, (SELECT count(*) FROM gold JOIN {0} t ON t.qid = gold.qid AND t.pid = gold.pid WHERE gold.qid = qs.qid AND t.rank < ks.k) AS h FROM qs, ks"


def _bm25_sql(name: str, k: int, stop: bool) -> str:
    kept = f"WHERE term NOT IN ({_STOP})" if stop else ""
    w = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9à-öø-ÿ_]{{2,}}')"
    return f"""
    {name}t AS (SELECT pid, term FROM (SELECT doc_id AS pid, unnest({w('text')}) AS term FROM documents) AS x {kept}),
    {name}l AS (SELECT doc_id AS pid, len(list_filter({w('text')}, lambda z: {'z NOT IN (' + _STOP + ')' if stop else 'true'})) AS dl FROM documents),
    {name}q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({w('text')}) AS term FROM benchmark) AS x {kept} GROUP BY ALL),
    {name}f AS (SELECT pid, term, count(*) AS tf FROM {name}t GROUP BY ALL),
    {name}d AS (SELECT term, count(*) AS df FROM {name}f GROUP BY ALL),
    {name}c AS (SELECT count(*) AS n, avg(dl) AS a FROM {name}l),
    {name}s AS (SELECT q.qid, f.pid, round(sum(q.qtf * ln(1 + (c.n - d.df + 0.5) / (d.df + 0.5)) * f.tf / (f.tf + 1.5 * (1 - 0.75 + 0.75 * l.dl / c.a))), 6) AS score
        FROM {name}q q JOIN {name}f f USING (term) JOIN {name}d d USING (term) JOIN {name}l l ON l.pid = f.pid, {name}c c GROUP BY ALL),
    {name} AS ({_TOP.format(name + 's', k)})"""


_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_CONTAINED = f"""
    p AS (SELECT item_id, {_NORM.format('text')} AS p FROM benchmark), c AS (SELECT doc_id AS pid, {_NORM.format('text')} AS c FROM documents),
    pr AS (SELECT item_id, w, left(p, w) AS probe FROM p, (SELECT unnest([90, 60, 40]) AS w) AS ws WHERE length(p) >= w),
    ht AS (SELECT item_id, w, pid FROM pr JOIN c ON contains(c, probe)),
    cont AS (SELECT DISTINCT item_id, pid FROM ht WHERE w = (SELECT max(w) FROM ht h WHERE h.item_id = ht.item_id))"""

_PAGERANK = f"""
    WITH {_VECTORS}, z AS (SELECT qid, pid, score FROM s WHERE j = 0), t AS ({_TOP.format('z', K)}), e AS (SELECT qid AS src, pid AS dst, score AS w FROM t WHERE score > 0),
    b AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e), o AS (SELECT src, sum(w) AS total FROM b GROUP BY ALL), sh AS (SELECT src, dst,
        w / total AS share FROM b JOIN o USING (src)),
    st AS (SELECT qid AS node, round((label + 1) / (sum(label + 1) OVER ())::DOUBLE, 9) AS r FROM q WHERE j = 0), p0 AS (SELECT node, r AS score FROM st),
    {", ".join(f"p{i} AS (SELECT node, round(sum(x), 9) AS score FROM (SELECT node, r * 0.5::DOUBLE AS x FROM st UNION ALL SELECT sh.dst, p.score * sh.share * 0.5::DOUBLE FROM p{i - 1} p JOIN sh ON sh.src = p.node) AS u GROUP BY ALL)" for i in (1, 2, 3))}
    SELECT node, round(score, 6) AS score FROM p3"""


def _tier_sql(t: int) -> str:
    """One round of the spread: f{t - 1} is the frontier, u{t - 1} the sentences used before, a{t - 1} what is active."""
    return f"""
    o{t} AS (SELECT f.qid, f.entity, f.score, m.sentence, g.gate FROM f{t - 1} f JOIN m USING (entity) JOIN g ON g.sentence = m.sentence WHERE NOT EXISTS
        (SELECT 1 FROM u{t - 1} u WHERE u.qid = f.qid AND u.sentence = m.sentence)),
    b{t} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, entity ORDER BY gate DESC, sentence) AS r FROM o{t}) AS x WHERE r <= 2),
    k{t} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, sentence ORDER BY score DESC, entity) AS w FROM b{t}) AS x WHERE w = 1),
    f{t} AS (SELECT k.qid, m.entity, round(sum(k.score * k.gate), 6) AS score FROM k{t} k JOIN m ON m.sentence = k.sentence WHERE m.entity <> k.entity AND
        k.score * k.gate >= 0.5 GROUP BY ALL),
    a{t} AS (SELECT qid, entity, round(sum(score), 6) AS score, min(tier) AS tier, max(last_tier) AS last_tier FROM (SELECT * FROM a{t - 1} UNION ALL
        SELECT qid, entity, score, {t}, {t} FROM f{t}) AS x GROUP BY ALL),
    u{t} AS (SELECT * FROM u{t - 1} UNION ALL SELECT qid, sentence FROM k{t})"""


_SPREAD = rf"""
    WITH se AS (SELECT item_id AS qid, unnest(string_split(regexp_replace(text, '([.!?])\s', '\1' || chr(1), 'g'), chr(1))) AS s,
        generate_subscripts(string_split(regexp_replace(text, '([.!?])\s', '\1' || chr(1), 'g'), chr(1)), 1) - 1 AS p FROM benchmark),
    m AS (SELECT qid * 1000 + p AS sentence, unnest(list_distinct(regexp_extract_all(s, '[A-Za-z]{{2,}}'))) AS entity FROM se),
    g AS (SELECT sentence, round(0.5::DOUBLE + 0.5::DOUBLE / count(*), 6) AS gate FROM m GROUP BY ALL),
    f1 AS (SELECT item_id AS qid, regexp_extract(text, '[A-Za-z]{{2,}}') AS entity, 1.0::DOUBLE AS score FROM benchmark WHERE regexp_matches(text, '[A-Za-z]{{2,}}')),
    a1 AS (SELECT qid, entity, score, 1 AS tier, 1 AS last_tier FROM f1), u1 AS (SELECT 0 AS qid, 0 AS sentence WHERE false), {_tier_sql(2)}, {_tier_sql(3)}"""



def _path_sql(t: int) -> str:
    """One round of the spread along a path: the gate of tier t - 1 is the best of rows 0 and t - 1 of the query set."""
    return _tier_sql(t).replace("JOIN g ON g.sentence = m.sentence", f"JOIN g{t - 1} g ON g.qid = f.qid AND g.sentence = m.sentence").replace(">= 0.5", ">= 0.05").replace("r <= 2", "r <= 3")


_SIGMA = rf"""
    WITH q AS (SELECT vec_id - vec_id % 50 AS qid, vec_id % 50 AS j, embedding, label FROM embeddings WHERE vec_id % 50 <= 3),
    s AS (SELECT q.qid, q.j, e.vec_id AS sentence, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM
        q, embeddings e WHERE q.j < 3),
    g1 AS (SELECT qid, sentence, max(score) AS gate FROM s WHERE j IN (0, 1) GROUP BY ALL), g2 AS (SELECT qid, sentence, max(score) AS gate FROM s WHERE j IN (0, 2) GROUP BY ALL),
    m AS (SELECT unnest(['label ' || CAST(label AS VARCHAR), 'part ' || CAST(vec_id % 97 AS VARCHAR)]) AS entity, vec_id AS sentence FROM embeddings),
    f1 AS (SELECT qid, 'label ' || CAST(label AS VARCHAR) AS entity, 1.0::DOUBLE AS score FROM q WHERE j = 0),
    a1 AS (SELECT qid, entity, score, 1 AS tier, 1 AS last_tier FROM f1), u1 AS (SELECT 0 AS qid, 0 AS sentence WHERE false), {_path_sql(2)}, {_path_sql(3)}
    SELECT * FROM a3"""

_ORDER = f"""{_SIGMA.replace("SELECT * FROM a3", "")}, z AS (SELECT qid, sentence AS pid, score FROM s WHERE j = 0 AND sentence NOT BETWEEN qid AND qid + 3), t AS ({_TOP.format('z', K)}),
    w AS (SELECT t.qid, t.pid, round((1.5::DOUBLE * CASE WHEN max(score) OVER n = min(score) OVER n THEN 1.0::DOUBLE ELSE round((score - min(score) OVER
        n) / (max(score) OVER n - min(score) OVER n), 6) END + CASE WHEN e.label = q.label THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) * 0.05::DOUBLE, 9) AS weight
          FROM t JOIN embeddings e ON e.vec_id = t.pid JOIN q ON q.qid = t.qid AND q.j = 0 WINDOW n AS (PARTITION BY t.qid)),
    b AS (SELECT 'e:' || entity AS src, 'p:' || CAST(sentence AS VARCHAR) AS dst FROM m UNION ALL SELECT 'p:' || CAST(sentence AS VARCHAR), 'e:' || entity
        FROM m), o AS (SELECT src, count(*)::DOUBLE AS total FROM b GROUP BY ALL), sh AS (SELECT src, dst, 1.0::DOUBLE / total AS share FROM b JOIN o USING
        (src)),
    re AS (SELECT qid, 'e:' || entity AS node, score AS weight FROM a3 UNION ALL SELECT qid, 'p:' || CAST(pid AS VARCHAR), weight FROM w),
    st AS (SELECT qid, node, round(weight / sum(weight) OVER (PARTITION BY qid), 9) AS r FROM re WHERE weight > 0), p0 AS (SELECT qid, node, r AS score FROM st),
    {", ".join(f"p{i} AS (SELECT qid, node, round(sum(x), 9) AS score FROM (SELECT qid, node, r * 0.5::DOUBLE AS x FROM st UNION ALL SELECT p.qid, sh.dst, p.score * sh.share * 0.5::DOUBLE FROM p{i - 1} p JOIN sh ON sh.src = p.node) AS u GROUP BY ALL)" for i in (1, 2))},
    y AS (SELECT qid, CAST(substr(node, 3) AS BIGINT) AS pid, score FROM p2 WHERE node LIKE 'p:%') {_TOP.format('y', K)}"""

ORACLE_SQL = {
    "sigma_spread": _SIGMA,
    "passage_order": _ORDER,
    "passage_bonus": f"""{_SPREAD}, n AS (SELECT doc_id AS pid, w.entity, (length(lower(text)) - length(replace(lower(text), lower(w.entity), ''))) / length(w.entity) AS n
        FROM documents, (SELECT DISTINCT entity FROM a3) AS w WHERE contains(lower(text), lower(w.entity))) SELECT qid, pid, round(sum(score * ln(1 + n) /
        last_tier), 6) AS bonus FROM a3 JOIN n USING (entity) GROUP BY ALL""",
    "pagerank_vectors": _PAGERANK,
    "entity_spread": f"{_SPREAD} SELECT * FROM a3",
    "tier_histogram": f"""{_SPREAD} SELECT tier, count(*) AS n, round(max(score), 6) AS best, count(*) FILTER (contains(lower(b.text), lower(entity))) AS gold_hits FROM a3 JOIN
        benchmark b ON b.item_id = a3.qid GROUP BY tier""",
    "views_donors": """WITH h AS (SELECT item_id AS qid, md5('views-0-' || CAST(item_id AS VARCHAR)) AS h FROM benchmark) SELECT qid, coalesce(lead(qid) OVER (ORDER BY h,
        qid), first(qid) OVER (ORDER BY h, qid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS donor FROM h""",
    "views_shuffled": r"""WITH h AS (SELECT item_id AS qid, md5('views-0-' || CAST(item_id AS VARCHAR)) AS h, text AS q, regexp_extract_all(text, '[^.!?]+[.!?]') AS v FROM
        benchmark), n AS (SELECT qid, coalesce(lead(qid) OVER (ORDER BY h, qid), first(qid) OVER (ORDER BY h, qid ROWS BETWEEN UNBOUNDED PRECEDING AND
        UNBOUNDED FOLLOWING)) AS donor FROM h) SELECT a.qid, CAST(len(b.v) + 1 AS INTEGER) AS n_views, md5(array_to_string(list_concat([a.q], b.v), '|')) AS views_md5 FROM n JOIN h a USING (qid) JOIN h b ON b.qid = n.donor""",
    "offset_lookup": f"""WITH {_CONTAINED}, z AS (SELECT pid, c, CAST(sum(length(c) + 1) OVER (ORDER BY pid) - length(c) - 1 AS BIGINT) AS s FROM c), x AS (SELECT
        cont.item_id, z.s + strpos(z.c, left(p.p, 40)) - 1 AS a, length(p.p) AS n FROM cont JOIN p USING (item_id) JOIN z USING (pid)), k AS (SELECT item_id,
        unnest([a, a + n]) AS place FROM x) SELECT item_id, place, (SELECT max(pid) FROM z WHERE z.s <= k.place) AS pid FROM k""",
    "passage_identity": "SELECT md5(source || '||' || text) AS key, max(doc_id) AS pid FROM documents GROUP BY 1",
    "title_lookup": "SELECT source AS title, CAST(count(DISTINCT doc_id) AS INTEGER) AS n_pids, min(doc_id) AS first_pid FROM documents GROUP BY 1",
    "corpus_stats": r"""SELECT count(*) AS passages, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words, CAST(sum(len(regexp_extract_all(text, '[.!?]+\s')) +
        1) AS BIGINT) AS sentences, count(DISTINCT source) AS titles, count(*) FILTER (regexp_matches(text, '#[0-9]')) AS placeholders FROM documents""",
    "norm_ascii": f"SELECT doc_id AS pid, md5({_NORM.format('text')}) AS norm_md5 FROM documents",
    "norm_question": r"""SELECT doc_id AS pid, md5(trim(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'),
        '\s+', ' ', 'g'))) AS key_md5 FROM documents""",
    "content_counts": rf"""SELECT doc_id AS pid, CAST(len(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9'']+'), lambda w: w NOT IN ({_STOP}))) AS INTEGER) AS content,
        CAST(len(sp) - CASE WHEN len(sp) > 0 AND starts_with(text, sp[1]) AND lower(sp[1]) IN ({_STOP}) THEN 1 ELSE 0 END AS INTEGER) AS entities FROM (SELECT
        doc_id, text, regexp_extract_all(text, '\b([A-Z][a-z0-9]+(?:\s+(?:of|the|de|and)?\s*[A-Z][a-z0-9]+)*)', 1) AS sp FROM documents) AS x""",
    "gold_containment": f"WITH {_CONTAINED} SELECT * FROM cont",
    "bm25_topk": f"WITH {_bm25_sql('b', 5, False)} SELECT * FROM b",
    "hybrid_rrf": f"""WITH {_bm25_sql('x1', 15, False)}, {_bm25_sql('x2', 15, True)}, u AS (SELECT qid, 0 AS l, rank, pid FROM x1 UNION ALL SELECT qid, 1, rank, pid FROM
        x2), f AS (SELECT qid, pid, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score, min(l * 1000 + rank) AS seen FROM u GROUP BY ALL) SELECT qid,
        CAST(r - 1 AS INTEGER) AS rank, pid, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS r FROM f) AS x WHERE r <=
        5""",
    "rerank_overlap": f"""WITH {_bm25_sql('b', 20, False)}, w AS (SELECT b.qid, b.pid, list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9à-öø-ÿ_]{{2,}}')) AS qw,
        list_distinct(regexp_extract_all(lower(p.text), '[a-z0-9à-öø-ÿ_]{{2,}}')) AS pw FROM b JOIN benchmark q ON q.item_id = b.qid JOIN documents p ON
        p.doc_id = b.pid), s AS (SELECT qid, pid, round(len(list_intersect(qw, pw)) / len(qw)::DOUBLE, 6) AS score FROM w) {_TOP.format('s', 5)}""",
    "dense_topk": f"WITH {_VECTORS}, z AS (SELECT qid, pid, score FROM s WHERE j = 0) {_TOP.format('z', K)}",
    "sigma_max_topk": f"WITH {_VECTORS} {_TOP.format('smax', K)}",
    "fusion_mean": f"WITH {_VECTORS} {_TOP.format('smean', K)}",
    "fusion_rrf": f"""WITH {_VECTORS}, t AS (SELECT *, row_number() OVER (PARTITION BY qid, j ORDER BY score DESC, pid) - 1 AS rank FROM s), f AS (SELECT qid, pid,
        round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score, min(j * 1000 + rank) AS seen FROM t WHERE rank < 30 GROUP BY ALL) SELECT qid, CAST(r - 1 AS
        INTEGER) AS rank, pid, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS r FROM f) AS x WHERE r <= {K}""",
    "fact_minmax": f"""WITH {_VECTORS} SELECT qid, pid, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE round((score - min(score) OVER w) / (max(score)
        OVER w - min(score) OVER w), 6) END AS score FROM smax WINDOW w AS (PARTITION BY qid)""",
    "recall_by_bucket": f"""WITH {_VECTORS}, t AS ({_TOP.format('smax', K)}), r AS ({_RECALLS.format('t')}) SELECT CASE WHEN grouping(shape) = 0 THEN 'shape' WHEN
        grouping(n_hops) = 0 THEN 'n_hops' ELSE 'overall' END AS section, CASE WHEN grouping(shape) = 0 THEN CAST(shape AS VARCHAR) WHEN grouping(n_hops) = 0
        THEN CAST(n_hops AS VARCHAR) ELSE '' END AS bucket, k, round(avg(h / nullif(g, 0)::DOUBLE), 6) AS mean, count(nullif(g, 0)) AS n, count(*) AS n_all
        FROM r GROUP BY GROUPING SETS ((k), (k, shape), (k, n_hops)) HAVING count(nullif(g, 0)) > 0 OR (grouping(shape) = 1 AND grouping(n_hops) = 1)""",
    "paired_delta": f"""WITH {_VECTORS}, z AS (SELECT qid, pid, score FROM s WHERE j = 0), tp AS ({_TOP.format('z', K)}), tm AS ({_TOP.format('smax', K)}), ta AS
        ({_TOP.format('smean', K)}), rp AS ({_RECALLS.format('tp')}), rm AS ({_RECALLS.format('tm')}), ra AS ({_RECALLS.format('ta')}), d AS (SELECT 'max' AS
        arm, rm.k, rm.shape, rm.h / nullif(rm.g, 0)::DOUBLE - rp.h / nullif(rp.g, 0)::DOUBLE AS delta FROM rm JOIN rp USING (qid, k) UNION ALL SELECT 'mean',
        ra.k, ra.shape, ra.h / nullif(ra.g, 0)::DOUBLE - rp.h / nullif(rp.g, 0)::DOUBLE FROM ra JOIN rp USING (qid, k)) SELECT arm, k, coalesce(CAST(shape AS
        VARCHAR), 'all') AS bucket, round(avg(delta), 6) AS delta, count(*) AS n FROM d WHERE delta IS NOT NULL GROUP BY GROUPING SETS ((arm, k), (arm, k,
        shape))""",
    "best_over_views": f"""WITH {_VECTORS}, t AS (SELECT *, row_number() OVER (PARTITION BY qid, j ORDER BY score DESC, pid) AS r FROM s), gc AS (SELECT qid, count(*) AS g FROM
        gold GROUP BY ALL), p AS (SELECT t.qid, t.j, count(gold.pid) / max(gc.g)::DOUBLE AS recall FROM t LEFT JOIN gold ON gold.qid = t.qid AND gold.pid =
        t.pid LEFT JOIN gc ON gc.qid = t.qid WHERE r <= {K} GROUP BY ALL) SELECT qid, round(max(recall), 6) AS recall FROM p GROUP BY ALL""",
    "per_hop_recall": f"""WITH {_VECTORS}, t AS ({_TOP.format('smax', K)}), hp AS (SELECT q.qid, q.j AS hop, min(e.vec_id) AS pid FROM q JOIN embeddings e ON e.label = q.label
        WHERE q.j > 0 AND e.vec_id NOT BETWEEN q.qid AND q.qid + 3 GROUP BY ALL) SELECT hop, k, round(avg(CASE WHEN t.rank < k THEN 1.0::DOUBLE ELSE
        0.0::DOUBLE END), 6) AS mean, count(*) AS n FROM hp LEFT JOIN t ON t.qid = hp.qid AND t.pid = hp.pid, ks GROUP BY ALL""",
    "option_recall": f"""WITH {_CONTAINED}, {_bm25_sql('b', 5, False)} SELECT item_id AS qid, CASE WHEN item_id IN (SELECT item_id FROM cont) THEN CASE WHEN EXISTS (SELECT 1
        FROM cont JOIN b ON b.qid = cont.item_id AND b.pid = cont.pid WHERE cont.item_id = benchmark.item_id) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS
        recall FROM benchmark""",
    "edge_weight": f"""WITH {_VECTORS}, z AS (SELECT qid, pid, score FROM s WHERE j = 0), t AS ({_TOP.format('z', K)}), m AS (SELECT e.vec_id AS node,
        round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), 6) AS sim FROM embeddings e, (SELECT embedding FROM
        embeddings WHERE vec_id = 0) AS o) SELECT t.qid AS src, t.pid AS dst, round(t.score * a.sim * b.sim, 6) AS w FROM t JOIN m a ON a.node = t.qid JOIN m
        b ON b.node = t.pid""",
    "rekey_collisions": "SELECT source AS qkey, md5(max_by(text, doc_id)) AS last, count(DISTINCT text) AS n_sets FROM documents GROUP BY 1",
}
