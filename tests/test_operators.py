"""Automata, gates on demand, the lexical index and work along an order, against plain Python."""

import bisect
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import graph, lexical, matching, ordered, rank, substrings
from quillspark.plans import catalogue

SF = "/root/testdata/sf0.01"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abAé ", min_size=1, max_size=4), min_size=1, max_size=6, unique=True), st.text("abAé ", max_size=40))
def test_counts_equal_those_of_plain_strings(patterns, text):
    assert substrings.counts(substrings.automaton(patterns), text) == {p: text.count(p) for p in patterns if p in text}


@pytest.mark.parametrize("size", [50_000, 3])
def test_occurrences_of_pattern_files(spark, monkeypatch, size):
    monkeypatch.setattr(substrings, "PATTERNS_A_FILE", size)
    monkeypatch.setattr(substrings, "CHARACTERS_KEPT", 20)
    rng = random.Random(2)
    texts = [(i, None if i % 9 == 0 else "".join(rng.choice("abc") for _ in range(rng.randrange(80)))) for i in range(60)]
    patterns = [*{"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(25)}, "", "zzz"]
    got = substrings.occurrences(spark.createDataFrame(texts, "id int, text string").repartition(3), spark.createDataFrame([(p,) for p in [*patterns, patterns[0], None]], "p string").repartition(2))
    assert sorted(map(tuple, got.collect())) == sorted((i, p, t.count(p)) for i, t in texts if t for p in patterns if p and p in t)
    assert substrings.occurrences(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([], "p string")).count() == 0


def test_bonus_counts_parts_of_words(spark):
    active = spark.createDataFrame([(1, "Art", 0.5, 1, 2)], "qid int, entity string, score double, tier int, last_tier int")
    texts = spark.createDataFrame([(7, "the party of ART and arts"), (8, "none")], "pid long, text string")
    assert [(r.qid, r.pid, r.bonus) for r in graph.passage_bonus(active, texts).collect()] == [(1, 7, round(0.5 * math.log(4) / 2, 6))]
    assert graph.tier_report(active, spark.createDataFrame([(1, "A party"), (2, "art")], "qid int, text string")).first().gold_hits == 1


def test_contained_equals_a_scan(spark):
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice("ab cd") for _ in range(n))
    items = [(i, line(rng.randrange(30, 130))) for i in range(30)] + [(31, ""), (32, None)]
    chunks = [(i, line(20) + (items[i % 30][1] or "")[: rng.choice([45, 65, 95, 130])] + line(30)) for i in range(90)]
    norm = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()
    want = set()
    for i, t in items:
        for w in matching.WIDTHS:
            hits = {(i, c) for c, x in chunks if len(norm(t)) >= w and norm(t)[:w] in norm(x)}
            if hits:
                want |= hits
                break
    got = matching.contained(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(chunks, "pid long, text string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("window", [None, 0, 1])
def test_gates_on_demand_equal_those_of_a_table(spark, window):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((40, 5)).round(3)
    sets = [(q, j, [float(x) for x in rng.standard_normal(5).round(3)]) for q in (1, 2, 3) for j in range(q + 1)]
    sentences = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "sentence int, embedding array<float>")
    seeds = spark.createDataFrame([(q, "a", 1.0) for q in (1, 2, 3)], "qid int, entity string, score double")
    mentions = spark.createDataFrame([(e, int(s)) for e in "abcdef" for s in rng.choice(40, 14, replace=False)] + [("a", 99)], "entity string, sentence int")
    made = graph.vector_gates(sentences, spark.createDataFrame(sets, "qid int, j int, embedding array<float>"), window)
    table = []
    for q, j, e in sets:
        m = q + 1
        table += [(q, i, j, m, round(float(np.dot(np.float32(v).astype(float), np.float32(e).astype(float))), 6)) for i, v in enumerate(vectors)]
    stored = graph.table_gates(spark.createDataFrame(table, "qid int, sentence int, j int, m int, gate double"), 99 if window is None else window)
    one, other = (sorted(map(tuple, graph.spread(seeds, mentions, g, 0.3, 3, 3).collect())) for g in (made, stored))
    assert one == other and len(one) > 6


def test_no_plan_of_the_spread_has_a_cross_join(spark):
    plan = catalogue.sigma_spread(spark, SF)._jdf.queryExecution().toString() + catalogue.entity_spread(spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_passage_order_moves_classes_of_passages(spark, monkeypatch, rounds):
    """a round moved a score for each query and passage; passages with equal edges now share one, and the order is PageRank's."""
    rng = random.Random(rounds)
    kinds = [sorted(rng.sample(range(6), rng.randrange(1, 4))) for _ in range(9)]
    edges = [(f"e:n{e}", f"p:{p}", 2.0 if p % 9 == 4 else 1.0) for p in range(400) for e in kinds[p % 9]]
    edges += [("p:7", "p:500", 1.0), ("p:500", "e:n1", 0.5), ("e:n0", "e:n5", 3.0), ("e:n2", "p:11", 1.0), ("p:16", "p:25", 1.0)]
    active = [(q, f"n{rng.randrange(6)}", round(rng.random(), 6)) for q in range(12) for _ in range(2)]
    weights = [(q, p, round(rng.random() / 9, 6)) for q in range(12) for p in rng.sample([*range(30), 500, 900], 5)] + [(12, 900, 1.0), (13, 3, 0.0)]
    e = spark.createDataFrame(edges, "src string, dst string, w double").repartition(3)
    a, w = spark.createDataFrame(active, "qid int, entity string, score double").groupBy("qid", "entity").max("score").toDF("qid", "entity", "score"), spark.createDataFrame(weights, "qid int, pid long, weight double")
    reset = a.selectExpr("qid", "'e:' || entity AS node", "score AS weight").union(w.selectExpr("qid", "'p:' || pid", "weight")).filter("weight > 0")
    whole = graph.pagerank(e, reset, 0.5, rounds).filter("node LIKE 'p:%'").selectExpr("qid", "cast(substring(node, 3) AS long) AS pid", "score")
    want = sorted((r.qid, r["rank"], r.pid, r.score) for r in rank.top_k(whole, 7).collect())
    moved, real = [], graph._flow
    monkeypatch.setattr(graph, "_flow", lambda scores, *x: moved.append(scores) or real(scores, *x))
    got = sorted((r.qid, r["rank"], r.pid, r.score) for r in graph.passage_order(e, a, w, 7, 0.5, rounds).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1.1e-9)
    assert len(moved) == rounds and max(df.groupBy("qid").count().agg({"count": "max"}).first()[0] for df in moved) < 40


def plain_bm25(docs, queries, k, stop=()):
    split = lambda t: [w for w in re.findall(r"[a-z0-9à-öø-ÿ_]{2,}", (t or "").lower()) if w not in stop]
    words = {p: split(t) for p, t in docs}
    mean = sum(map(len, words.values())) / max(len(words), 1) or 1
    out = []
    for q, t in queries:
        scores = {}
        for w in split(t):
            df = sum(w in x for x in words.values())
            for p, x in words.items():
                if w in x:
                    tf = x.count(w)
                    scores[p] = scores.get(p, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(x) / mean))
        out += [(q, r, p) for r, (p, _) in enumerate(sorted(((p, round(s, 6)) for p, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, rows", [(1 << 20, 1 << 16), (60, 5)])
def test_bm25_with_bounds_equals_plain_scores(spark, monkeypatch, block, rows):
    monkeypatch.setattr(lexical, "WORDS_A_BLOCK", block)
    monkeypatch.setattr(lexical, "ROWS_A_FILE", rows)
    rng = random.Random(block)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(400)]
    docs = [(i, None if i % 50 == 3 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    queries = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 9)))) for i in range(25)] + [(90, "absent words"), (91, None)]
    d, q = spark.createDataFrame(docs, "pid long, text string").repartition(3), spark.createDataFrame(queries, "qid int, question string")
    stop = ["w1", "w2"]
    index = lexical.build(d, rank.words, stop)
    for s in ([], stop):
        got = sorted((r.qid, r["rank"], r.pid) for r in rank.bm25_on(index, q, 5, s or None).collect())
        want = plain_bm25(docs, queries, 5, s)
        assert got == want
    assert rank.bm25(d.limit(0), q, 3).count() == 0 and rank.bm25(d, q.limit(0), 3).count() == 0


def test_bounds_score_few_of_the_passages(spark, monkeypatch):
    """A query of one rare and three very common words: only passages with the rare word, and few others, are scored."""
    monkeypatch.setattr(lexical, "WORDS_A_BLOCK", 2000)
    rng = random.Random(8)
    docs = [(i, " ".join(["the", "of", "and"] * rng.randrange(1, 9)) + (f" rare{i % 7}" if i % 29 == 0 else "")) for i in range(3000)]
    queries = [(i, f"the of and rare{i}") for i in range(7)]
    d, q = spark.createDataFrame(docs, "pid long, text string").coalesce(1), spark.createDataFrame(queries, "qid int, question string")
    index = lexical.build(d, rank.words)
    seen = lexical.merged([lexical.search(index, q, 3, rank.words, report=True)]).first()
    assert seen.passages >= 0.9 * 7 * 3000 and seen.scored < 0.25 * seen.passages and seen.skipped > seen.blocks / 2
    assert sorted((r.qid, r["rank"], r.pid) for r in rank.bm25_on(index, q, 3).collect()) == plain_bm25(docs, queries, 3)


def test_counts_of_a_query_follow_its_terms_not_the_vocabulary(spark, monkeypatch):
    """F2 to F9: joins took the words of all blocks for small, since the index has paths only, and broadcast them by way of the driver."""
    monkeypatch.setattr(lexical, "WORDS_A_BLOCK", 100)
    monkeypatch.setattr(lexical, "ROWS_A_FILE", 2)
    d = spark.createDataFrame([(i, " ".join(f"own{i}x{j}" for j in range(20)) + " common" * (i % 2)) for i in range(200)], "pid long, text string")
    q = spark.createDataFrame([(1, "common own7x3 absent"), (2, "common own8x0 own9x0")], "qid int, question string")
    index, written, real = lexical.build(d, rank.words), [], lexical.grouped_files
    monkeypatch.setattr(lexical, "grouped_files", lambda df, *a, **b: written.append(df) or real(df, *a, **b))
    terms = spark.createDataFrame([("common",), ("own7x3",), ("absent",), ("common",)], "term string")
    counted = lexical.document_counts(index, terms)
    assert sorted(map(tuple, counted.collect())) == [("common", 100), ("own7x3", 1)]
    assert "Join" not in counted._jdf.queryExecution().executedPlan().toString()
    found = rank.bm25_on(index, q, 3)
    assert written and not any("BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString() for df in written)
    assert {r.qid: r.pid for r in found.filter("rank = 0").collect()} == {1: 7, 2: 9}


def test_query_files_keep_groups_whole(spark):
    from quillspark.storage import grouped_files, read_arrow, shared_files

    rng = random.Random(6)
    rows = [(f"q{g}", j) for g in range(30) for j in range(rng.choice([1, 3, 40]))]
    rng.shuffle(rows)
    folder = grouped_files(spark.createDataFrame(rows, "qid string, j int").repartition(5), "qid", ["j"], 7, "test")
    tables = [read_arrow(f"{folder}/{n}").to_pylist() for n in shared_files(folder)]
    flat = [(r["qid"], r["j"]) for t in tables for r in t]
    assert sorted(flat) == sorted(rows) and len(tables) > 5
    homes = {}
    for i, t in enumerate(tables):
        for r in t:
            assert homes.setdefault(r["qid"], i) == i
        js = [r["j"] for r in t]
        assert all(a["qid"] != b["qid"] or a["j"] < b["j"] for a, b in zip(t, t[1:])) and js


@pytest.mark.parametrize("n, parts", [(1, "4"), (40, "9"), (5000, "7"), (70_000, "5")])
def test_donors_are_the_next_of_all_at_every_size(spark, tmp_path, n, parts):
    spark.range(n).selectExpr("id * 3 as item_id", "cast(id as string) as text").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = catalogue.views_donors(spark, str(tmp_path)).toArrow().sort_by("qid")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    want = con.execute(f"SELECT * FROM ({catalogue.ORACLE_SQL['views_donors']}) ORDER BY qid").fetchall()
    assert list(zip(got.column("qid").to_pylist(), got.column("donor").to_pylist())) == want


def test_running_sums_and_lookups_at_any_number_of_ranges(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, 3, 10])) for i in rng.sample(range(500), 120)]
    starts = [(g, rng.randrange(100), rng.randrange(1000)) for g in ("a", "b", None) for _ in range(15)]
    asked = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(-5, 110)])) for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "6", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r.i: r.total for r in ordered.running(spark.createDataFrame(rows, "i int, n long"), ["i"], "n", "total").collect()}
            assert got == {i: sum(m or 0 for j, m in rows if j <= i) for i, _ in rows}
            left, right = spark.createDataFrame(asked, "i int, g string, at int"), spark.createDataFrame(starts, "g string, at int, v int")
            found = {r.i: r.v for r in ordered.as_of(left, right, "at", "v", ["g"]).collect()}
            want = {}
            for i, g, at in asked:
                mine = sorted((s, v) for h, s, v in starts if h == g)
                k = bisect.bisect_right([s for s, _ in mine], at) - 1 if at is not None else -1
                want[i] = mine[k][1] if k >= 0 else None
            assert found == want
            nexts = {r.i: r.after for r in ordered.with_next(spark.createDataFrame(rows, "i int, n long"), ["i"], "i", "after").collect()}
            order = sorted(i for i, _ in rows)
            assert nexts == dict(zip(order, [*order[1:], None]))
        assert ordered.with_next(left.limit(0), ["i"], "i", "x", True).count() == 0 and ordered.as_of(left.limit(0), right, "at", "v").count() == 0
        assert {r.v for r in ordered.as_of(left, right.limit(0), "at", "v").collect()} == {None}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_best_takes_the_first_of_equal_scores():
    s = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    assert rank._best(s, 2).tolist() == [[False, True, True, False, False], [True, True, False, False, False]]
    assert pa.array(rank._best(s, 9).ravel()).to_pylist() == [True] * 10


def test_dense_scores_make_no_job_but_the_query_files(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0])], "pid long, embedding array<float>")
    q = spark.createDataFrame([(i, 0, [1.0, float(i)]) for i in range(50)], "qid long, j int, embedding array<float>")
    got = rank.dense_arms(items, q, ["pooled", "max", "mean"], 1)
    assert got.groupBy("arm").agg(F.sum("score").alias("s")).filter("s = 50").count() == 3


def test_reranked_reads_whole_texts_without_a_limit(spark):
    docs = spark.createDataFrame([(1, "filler " * 500 + "needle"), (2, "filler " * 500)], "pid long, text string")
    sets = spark.createDataFrame([(0, 0, "needle")], "qid long, j int, text string")
    cands = spark.createDataFrame([(0, 0, 2), (0, 1, 1)], "qid long, rank int, pid long")
    got = {r.pid: r.score for r in rank.reranked(cands, sets, docs, 2, model=rank.OverlapScorer, limit=None).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_rerank_dense_cuts_no_text(spark, tmp_path):
    from quillspark.plans import reports as plans

    spark.createDataFrame([(0, "filler " * 500 + "needle"), (1, "filler")], "doc_id long, text string").selectExpr("doc_id", "'s' AS source", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "needle")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.pid: r.score for r in plans.rerank_dense(spark, str(tmp_path)).collect()} == {0: 1.0, 1: 0.0}


def test_best_gates_pass_on_few_rows_of_a_frequent_entity(spark, monkeypatch):
    from quillspark.storage import read_arrow, shared_files

    folders, real = [], graph.grouped_files
    monkeypatch.setattr(graph, "grouped_files", lambda *a, **k: folders.append(real(*a, **k)) or folders[-1])
    monkeypatch.setattr(graph, "FRONTIER_A_FILE", 4)
    rng = np.random.default_rng(4)
    vectors, asked = rng.standard_normal((5000, 3)).round(3), rng.standard_normal((30, 3)).round(3)
    sentences = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "sentence long, embedding array<double>").coalesce(1)
    frontier = spark.createDataFrame([(q, "hot", 1.0) for q in range(30)], "qid long, entity string, score double")
    mentions = spark.createDataFrame([("hot", i) for i in range(5000)] + [("hot", 7)], "entity string, sentence long").coalesce(1)
    gates = graph.vector_gates(sentences, spark.createDataFrame([(q, 0, v.tolist()) for q, v in enumerate(asked)], "qid long, j int, embedding array<double>"))
    s = np.round(asked @ vectors.T, 6)
    used = spark.createDataFrame([(q, int(np.argmax(s[q]))) for q in range(0, 30, 2)], "qid long, sentence long")
    got = gates.best(frontier, mentions, used, 1, 2).collect()
    assert len(got) < 30 * 5000 / 4
    assert max(read_arrow(f"{folders[0]}/{n}").num_rows for n in shared_files(folders[0])) <= 8
    s[np.arange(0, 30, 2), s[::2].argmax(1)] = -np.inf
    for q in range(30):
        mine = sorted(((-r.gate, r.sentence) for r in got if r.qid == q))[:2]
        assert mine == sorted((-g, i) for i, g in [*enumerate(s[q]), (7, s[q, 7])])[:2]


def test_min_max_in_two_passes_moves_no_scores(spark):
    rows = spark.createDataFrame([(q, p, float(p * q)) for q in (0, 1, 2) for p in range(5)] + [(None, 1, 2.0), (None, 2, 4.0)], "qid long, pid long, score double")
    assert sorted(map(str, rank.min_max_in_two_passes(rows).collect())) == sorted(map(str, rank.min_max(rows).collect()))
    plan = catalogue.fact_minmax(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_scores_at_a_time_are_bounded(spark):
    for items, vectors in ((1024, 4096), (1024, 1), (7, 1 << 20), (0, 5)):
        parts = rank._pieces(items, vectors)
        assert [i for p in parts for i in range(p.start, p.stop)] == list(range(items))
        assert all((p.stop - p.start) * vectors <= rank.SCORES_AT_A_TIME or p.stop - p.start == 1 for p in parts)
    assert rank.SCORES_AT_A_TIME <= 1 << 20


def test_gold_of_frequent_titles_isnt_shuffled(spark, monkeypatch):
    from quillspark.sources import retrieval

    monkeypatch.setattr(retrieval, "TITLES_A_FILE", 50)
    passages = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 5), ("b", 900), ("b", 900), (None, 7), ("é", 3)], "title string, pid long")
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["none", None]), (3, None), (4, ["é"]), (5, [])], "ord long, titles array<string>")
    got = retrieval.with_title_ids(rows, passages)
    assert {r.ord: list(r.gold) for r in got.collect()} == {1: [*range(200), 900], 2: [], 3: [], 4: [3], 5: []}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_triple_question_comes_of_its_row(spark, monkeypatch):
    """steps were shuffled, joined with each other and with titles, and gathered again."""
    from quillspark.sources import retrieval

    monkeypatch.setattr(retrieval, "TITLES_A_FILE", 2)
    monkeypatch.setattr(retrieval, "GOLD_AT_A_TIME", 2)
    passages = spark.createDataFrame([("A", 4), ("A", 2), ("B", 9), ("C", 1), (None, 3)], "title string, pid long")
    schema = "ord long, _id string, question string, answer string, type string, supporting_facts array<array<string>>, evidences array<array<string>>"
    steps = [["A", "r1", "B"], ["B", "r2", "D"], ["D", "r3", "E"], [None, "r4", "F"], ["C", "r5", None]]
    rows = spark.createDataFrame([(1, "x", "Q?", "A", "comparison", [["A", "0"], ["B", "1"], ["A", "2"]], steps), (2, "y", "Q?", None, "compositional", [["none", "0"]], None), (3, "z", "Q?", "A", None, None, [])], schema)
    made = retrieval.triples_questions(rows, passages)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.ord: (r.gold, r.hops and [tuple(h) for h in r.hops], r.n_hops, r.is_join) for r in made.collect()}
    asks = ["What is the r1 of A?", "What is the r2 of #1?", "What is the r3 of #2?", None, "What is the r5 of C?"]
    assert got == {1: ([2, 4, 9], [*zip([1, 2, 3, 4, 5], asks, ["B", "D", "E", "F", None], [2, 9, None, None, 1])], 5, True), 2: ([], None, 1, False), 3: ([], None, None, None)}


def test_hits_are_passed_on_in_pieces():
    n = 2 * substrings.HITS_HELD + 3
    parts = list(substrings._in_pieces((i, "p", 1) for i in range(n)))
    assert [len(p) for p in parts] == [substrings.HITS_HELD] * 2 + [3] and [x[0] for p in parts for x in p] == list(range(n))
    assert not list(substrings._in_pieces(iter([])))


def test_a_task_reads_one_block_of_the_index_at_a_time(spark, monkeypatch):
    """The index's rows, which come in batches of thousands, don't hold the blocks."""
    monkeypatch.setattr(lexical, "WORDS_A_BLOCK", 2000)
    rng = random.Random(9)
    docs = [(i, None if i < 3 else " ".join(f"w{rng.randrange(500)}" for _ in range(60))) for i in range(400)]
    queries = [(i, f"w{i} w{i + 1} w{i}") for i in range(6)]
    d, q = spark.createDataFrame(docs, "pid long, text string").coalesce(1), spark.createDataFrame(queries, "qid int, question string")
    index = lexical.build(d, rank.words)
    rows = index.collect()
    assert len(rows) >= 10 and all(len(str(tuple(r))) < 500 for r in rows) and not {"pids", "places", "tfs"} & set(index.columns)
    assert sorted((r.qid, r["rank"], r.pid) for r in rank.bm25_on(index, q, 3).collect()) == plain_bm25(docs, queries, 3)
    assert rank.bm25(d.filter("pid < 3"), q, 3).count() == 0


def test_automata_that_a_task_keeps_are_bounded():
    assert substrings.CHARACTERS_KEPT + 2 * substrings.CHARACTERS_A_FILE <= 8 << 20  # about 45 bytes a character
