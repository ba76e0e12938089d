"""The retrieval engine against plain Python and, query by query, against DuckDB."""

import glob
import json
import math
import os
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from quillspark.functions import intervals, text
from quillspark.functions.stemming import stem
from quillspark.operators import graph, matching, metrics, rank, reports
from quillspark.plans import catalogue
from quillspark.sources import retrieval

SF = "/root/testdata/sf0.001"


def comparable(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else repr(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


ENGINE_SQL = {name: sql for module in __spark_entry__.ENGINE for name, sql in module.ORACLE_SQL.items()}


@pytest.mark.parametrize("name", [name for module in __spark_entry__.ENGINE for name in module.QUERIES])
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ENGINE_SQL:
        expected = duck.sql(ENGINE_SQL[name])
        assert sorted(df.columns) == sorted(expected.columns)
        assert comparable(rows, df.columns) == comparable(expected.fetchall(), expected.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sigma_max_is_at_least_pooled(spark):
    s = catalogue.vector_scores(spark, SF)
    both = rank.sigma_max(s).join(rank.pooled(s).withColumnRenamed("score", "q"), ["qid", "pid"])
    assert both.filter("score < q").count() == 0
    one = s.filter("j = 0")
    assert rank.sigma_max(one).exceptAll(rank.pooled(one)).count() == 0


def test_blocks_of_queries_give_the_same_scores(spark, monkeypatch):
    whole = {tuple(r) for r in catalogue.vector_scores(spark, SF).collect()}
    monkeypatch.setattr(rank, "QUERY_BLOCK", 7)
    assert {tuple(r) for r in catalogue.vector_scores(spark, SF).collect()} == whole


def test_kept_scores_hold_the_top(spark):
    items = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("pid"), "embedding")
    q = catalogue.vector_queries(spark, SF)
    full, cut = (rank.top_k(rank.dense_scores(items, q, keep), 5, "qid", "j") for keep in (None, 5))
    assert full.exceptAll(cut).count() == 0 == cut.exceptAll(full).count()


def test_rrf_ties_keep_the_first_seen(spark):
    lists = spark.createDataFrame([(1, 0, 0, 9), (1, 0, 1, 8), (1, 1, 0, 8), (1, 1, 1, 9), (1, 1, 2, 3)], "qid int, list_no int, rank int, pid long")
    assert [(r.rank, r.pid) for r in rank.rrf(lists, 3).orderBy("rank").collect()] == [(0, 9), (1, 8), (2, 3)]


def test_rerank_passes_unknown_queries_through(spark):
    cands = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 6), (2, 1, 5)], "qid int, rank int, pid long")
    sets = spark.createDataFrame([(1, 0, "green wheel"), (1, 1, "blue garden")], "qid int, j int, text string")
    docs = spark.createDataFrame([(5, "a wheel"), (6, "blue garden here")], "pid long, text string")
    got = {(r.qid, r["rank"]): r.pid for r in rank.reranked(cands, sets, docs, 2).collect()}
    assert got == {(1, 0): 6, (1, 1): 5, (2, 0): 6, (2, 1): 5}


def test_query_set_and_encoder(spark):
    q = spark.createDataFrame([(1, "who?"), (2, "what?")], "qid int, question string")
    s = spark.createDataFrame([(1, ["a b?", "c?"])], "qid int, texts array<string>")
    rows = rank.encoded(rank.query_set(q, s), lambda: rank.HashingEncoder(8)).collect()
    assert sorted((r.qid, r.j, r.text) for r in rows) == [(1, 0, "who?"), (1, 1, "a b?"), (1, 2, "c?"), (2, 0, "what?")]
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in rows)


def test_cosine_and_edges(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(rank.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.0)], "src int, dst int, w double")
    sims = spark.createDataFrame([(1, 0.5), (2, 0.4)], "node int, sim double")
    assert {(r.dst, r.w) for r in rank.edge_weights(edges, sims).collect()} == {(2, 0.1), (3, 0.0)}


def test_bootstrap_is_plain_numpy_whatever_the_partitions(spark):
    values = [(i, float(v)) for i, v in enumerate(np.random.default_rng(3).random(50))]
    df = spark.createDataFrame(values, "ord int, value double").withColumn("g", F.lit(1)).repartition(7)
    got = metrics.intervals(df, "g").first()
    x = np.array([v for _, v in values])
    means = x[np.random.default_rng(0).integers(0, 50, size=(2000, 50))].mean(axis=1)
    assert (got.lo, got.hi) == tuple(np.quantile(means, [0.025, 0.975]))
    assert all(math.isnan(v) for v in metrics.bootstrap_interval([1.0]))


def test_recall_rules(spark):
    q = spark.createDataFrame([(1, [1, 2], "a"), (2, [], "a"), (3, [7], "b")], "qid int, gold array<bigint>, shape string")
    r = spark.createDataFrame([(1, 0, 1), (1, 1, 9), (1, 2, 2)], "qid int, rank int, pid long")
    per = metrics.per_query(q, r, (2, 5))
    assert {(x.qid, x.k): x.recall for x in per.collect()} == {(1, 2): 0.5, (1, 5): 1.0, (2, 2): None, (2, 5): None, (3, 2): 0.0, (3, 5): 0.0}
    rows = metrics.report(per, "shape").collect()
    assert ("overall", "", 2, 0.25, 2, 3) in [tuple(x) for x in rows]
    assert "recall@2=0.2500" in metrics.rendered(rows, "t")
    with pytest.raises(ValueError):
        metrics.checked_overall(metrics.report(per.filter("qid = 2")))
    assert [metrics.marked(*x) for x in ((None, 0, 0, 0), (0.1, 0, 0, 1), (0.1, 0.05, 0.2, 9), (0.1, -0.1, 0.2, 9))] == ["-", "+0.1000 (n<2)", "+0.1000*", "+0.1000"]


def test_matching_ids_and_documents(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "pid long, text string")
    got = spark.createDataFrame([(1, 0, "x"), (1, 1, "zz")], "qid int, rank int, text string")
    assert [(r["rank"], r.pid) for r in matching.mapped_documents(got, docs).orderBy("rank").collect()] == [(0, 2), (1, -1)]
    runs = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2")], "arm string, qid string")
    q = spark.createDataFrame([("1",), ("2",)], "qid string")
    assert [r.qid for r in matching.scorable(q, q, runs).collect()] == ["1"]


def test_gates_of_a_path(spark):
    rows = spark.createDataFrame([(1, 1), (1, 4), (9, 4), (2, 4)], "t int, m int")
    assert [r[0] for r in rows.select(graph.gate_rows(F.col("t"), F.col("m"), 1)).collect()] == [[0], [0, 1, 2], [0, 2, 3], [0, 1, 2, 3]]


def test_spread_by_hand(spark):
    seeds = spark.createDataFrame([(1, "a", 1.0)], "qid int, entity string, score double")
    mentions = spark.createDataFrame([("a", 10), ("b", 10), ("b", 11), ("c", 11), ("a", 12), ("d", 12), ("a", 13), ("z", 13)], "entity string, sentence int")
    gates = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.3), (1, 13, 0.2)], "qid int, sentence int, gate double")
    got = {r.entity: (r.score, r.tier) for r in graph.spread(seeds, mentions, graph.table_gates(gates), 0.4, 2, 3).collect()}
    assert got == {"a": (1.0, 1), "b": (0.9, 2), "c": (0.72, 3)}
    texts = spark.createDataFrame([(7, "B and b, c"), (8, "none")], "pid long, text string")
    active = spark.createDataFrame([(1, "b", 0.9, 2, 2)], "qid int, entity string, score double, tier int, last_tier int")
    assert [(r.pid, r.bonus) for r in graph.passage_bonus(active, texts).collect()] == [(7, round(0.9 * math.log(3) / 2, 6))]


def test_pagerank_against_numpy(spark):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 1.0), (3, 0, 0.5)]
    df = graph.pagerank(spark.createDataFrame(edges, "src int, dst int, w double"), spark.createDataFrame([(1, 0, 1.0), (1, 3, 3.0)], "qid int, node int, weight double"), rounds=4)
    m = np.zeros((4, 4))
    for a, b, w in edges:
        m[a, b] += w
        m[b, a] += w
    m /= m.sum(1, keepdims=True)
    r = np.array([0.25, 0, 0, 0.75])
    x = r
    for _ in range(4):
        x = 0.5 * r + 0.5 * x @ m
    got = {row.node: row.score for row in df.collect()}
    assert all(abs(got.get(i, 0) - x[i]) < 1e-6 for i in range(4))


def test_pagerank_keeps_a_reset_node_without_edges(spark):
    df = graph.pagerank(spark.createDataFrame([(0, 1, 1.0)], "src int, dst int, w double"), spark.createDataFrame([(1, 9, 1.0)], "qid int, node int, weight double"), rounds=2)
    assert [(r.node, r.score) for r in df.collect()] == [(9, 0.5)]


def test_triples_are_checked(spark):
    df = spark.createDataFrame([('[["a","b","c"],["x"],["","y","z"]]',), ("import os",)], "t string")
    assert [r[0] for r in df.select(graph.valid_triples(F.col("t"))).collect()] == [[["a", "b", "c"]], None]


def test_views():
    q = "Who is the director of the film that was written by Jane Roe?"
    got = text.lexical_views(q)
    assert got[0] == q and len(got) <= 4 and len({v.lower() for v in got}) == len(got)
    assert text.opening("What is the capital's") == ""
    assert text.without_overlaps(["the of", "red wheel garden", "wheel garden", "wheel garden red", "blue sky"]) == ["red wheel garden", "wheel garden", "blue sky"]
    assert text.normal_key("  Café_Straße’s ﬁne ") == "cafe_strasse s fine"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 10**9), st.integers(1, 10**9)).map(lambda p: tuple(sorted(p))), min_size=1, max_size=4), min_size=1, max_size=4))
def test_valid_interval_files(cases):
    data = (f"{len(cases)}\n" + "".join(f"{len(c)}\n" + "".join(f"{a} {b}\n" for a, b in c) for c in cases)).encode()
    assert intervals.validate(data) == {"T": len(cases), "sum_N": sum(map(len, cases)), "max_N": max(map(len, cases)), "bytes": len(data)}
    for bad in (data[:-1], data + b"\n", data.replace(b" ", b"  ", 1), data.replace(b"\n", b"\r\n", 1), b"0" + data, b"-" + data, data.replace(b" ", b"\t", 1)):
        with pytest.raises(intervals.Malformed):
            intervals.validate(bad)


def test_interval_files_by_row(spark):
    df = spark.createDataFrame([("a", bytearray(b"1\n1\n1 2\n")), ("b", bytearray(b"1\n1\n3 2\n")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in intervals.validated(df).collect()}
    assert [got[p].status for p in "abc"] == ["OK", "INVALID", "UNREADABLE"] and got["a"].sum_n == 1 and "L_1 = 3 > R_1 = 2" in got["b"].message


def test_range_sort_against_python(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(20):
        v = [int(x) for x in rng.permutation(8) + 1]
        ops = [(int(rng.integers(1, 3)), *sorted(int(x) for x in rng.integers(1, 9, 2))) for _ in range(5)]
        rows.append((i, v, ops, int(rng.integers(1, 9))))
    df = spark.createDataFrame(rows, "id int, v array<int>, ops array<struct<c:int,l:int,r:int>>, x int")
    got = {r.id: r.p for r in df.select("id", intervals.place_after(F.col("v"), F.col("ops"), F.col("x")).alias("p")).collect()}
    for i, v, ops, x in rows:
        for c, a, b in ops:
            v = v[: a - 1] + sorted(v[a - 1 : b], reverse=c != 1) + v[b:]
        assert got[i] == v.index(x) + 1


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sets")
    passages = [{"title": "A", "text": "one"}, {"title": "A", "text": "two"}, {"title": "B", "text": "ü"}, {"title": "A", "text": "one"}]
    para = lambda i, t, x, s: {"idx": i, "title": t, "paragraph_text": x, "is_supporting": s}
    steps = [{"question": "Who made B?", "answer": "Z", "paragraph_support_idx": 0}, {"question": "Where was #1 and #1 born?", "answer": "Y", "paragraph_support_idx": None}]
    multi = [{"id": "2hop__1_2", "question": "q", "answer": "a", "paragraphs": [para(0, "B", "ü", True), para(1, "A", "one", True), para(2, "gone", "x", True), para(3, "A", "two", False)], "question_decomposition": steps}]
    wiki = [{"_id": "w1", "question": "q", "answer": "a", "type": "comparison", "supporting_facts": [["A", 0], ["none", 1]], "evidences": [["A", "maker", "B"], ["B", "age", "9"]]}, {"_id": "w2", "question": "q", "answer": "a", "type": "inference", "supporting_facts": [["B", 0]]}]
    plain = [{"question": "q", "paragraphs": [{"title": "B", "text": "ü", "is_supporting": True}]}, {"id": "x", "question": "q2", "answer": "a"}]
    files = {"musique": multi, "2wikimultihopqa": wiki, "popqa": plain}
    for name, data in files.items():
        (d / f"{name}_corpus.json").write_text(json.dumps(passages))
        (d / f"{name}.json").write_text(json.dumps(data))
    (d / "subq_x_raw.json").write_text(json.dumps({"1": ["a?", "b?"], "2": []}))
    (d / "bad.json").write_text("[1]")
    (d / "run_x_raw.json").write_text(json.dumps({"1": [3, 2]}))
    (d / "run_x_empty.json").write_text("[]")
    (d / "c.jsonl").write_text('{"qid": "1", "text": "t"}\n\n')
    (d / "chunks.json").write_text(json.dumps(["x", "y: z"]))
    (d / "trace.json").write_text('{"id": "1", "seeded": true, "n_seeds": 1, "used_sentences": 2, "entities": [["e", 1, 0.5]]}\n')
    return str(d)


def test_adapters(spark, folder):
    _, q = retrieval.load(spark, "musique", folder)
    r = q.first()
    assert (r.gold, [h.gold_pid for h in r.hops], r.shape, r.n_hops, r.is_join) == ([2, 3], [2, None], "2hop", 2, True)
    _, q = retrieval.load(spark, "2wikimultihopqa", folder)
    a, b = q.orderBy("ord").collect()
    assert (a.gold, [h.question for h in a.hops], [h.gold_pid for h in a.hops], a.n_hops, a.is_join) == ([0, 1, 3], ["What is the maker of A?", "What is the age of #1?"], [0, 2], 2, True)
    assert (b.gold, b.n_hops, b.is_join) == ([2], 1, False)
    _, q = retrieval.load(spark, "popqa", folder)
    assert [(r.qid, r.gold, r.answer, r.shape) for r in q.orderBy("ord").collect()] == [("0", [2], "", "single"), ("x", [], "a", "single")]
    with pytest.raises(KeyError, match="musique"):
        retrieval.load(spark, "nope", folder)


def test_files(spark, folder, tmp_path):
    sets = retrieval.query_sets(spark, f"{folder}/subq_x_raw.json")
    assert {r.qid: r.texts for r in sets.collect()} == {"1": ["a?", "b?"], "2": []}
    with pytest.raises(ValueError):
        retrieval.query_sets(spark, f"{folder}/bad.json")
    assert retrieval.discovered(["subq_x_zz.json", "subq_x_generated.json", "subq_x_raw.json", "subq_x_raw_bytext.json", "subq_y_raw.json"], "x") == ["subq_x_raw.json", "subq_x_generated.json", "subq_x_zz.json"]
    assert [tuple(r) for r in retrieval.runs(spark, [f"{folder}/run_x_raw.json", f"{folder}/run_x_empty.json"]).collect()] == [("raw", "1", [3, 2])]
    assert retrieval.completions(spark, f"{folder}/c.jsonl").count() == 1
    assert [r.text for r in retrieval.chunks(spark, f"{folder}/chunks.json").orderBy("pid").collect()] == ["0:x", "1:y: z"]
    assert [(r.entity, r.tier, r.score) for r in retrieval.traces(spark, f"{folder}/trace.json").collect()] == [("e", 1, 0.5)]
    texts, made = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string"), []
    encode = lambda t: (made.append(1), rank.encoded(t, lambda: rank.HashingEncoder(4)))[1]
    for t, n in ((texts, 1), (texts, 1), (texts.limit(1), 2)):
        assert retrieval.vectors(spark, str(tmp_path), t, encode, "x", "m", "queries").count() == t.count() and len(made) == n
    q = spark.createDataFrame([("1", "Who?", 0, [3, 1]), ("2", "What?", 1, [])], "qid string, question string, ord int, gold array<bigint>")
    assert [r.gold for r in retrieval.exported_gold(q).collect()] == [[[1], [3]]]
    assert [(r.qkey, r.texts) for r in retrieval.exported_sets(sets, q).collect()] == [("who", ["a?", "b?"])]


def test_dense_scores_of_string_ids_and_null_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.6, 0.8])], "pid long, embedding array<float>")
    q = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 0, None), ("c", 0, [0.0, 1.0])], "qid string, j int, embedding array<float>")
    each = {(r.qid, r.j, r.pid): r.score for r in rank.dense_scores(items, q).collect()}
    assert each == {("a", 0, 1): 1.0, ("a", 0, 2): 0.0, ("a", 0, 4): 0.6, ("a", 1, 1): 0.0, ("a", 1, 2): 1.0, ("a", 1, 4): 0.8, ("c", 0, 1): 0.0, ("c", 0, 2): 1.0, ("c", 0, 4): 0.8}
    best = {(r.qid, r.pid): r.score for r in rank.dense_scores(items.coalesce(1), q, 1, "max").collect()}
    assert best == {("a", 1): 1.0, ("c", 2): 1.0}
    assert {(r.qid, r.pid): r.score for r in rank.dense_scores(items, q, combine="mean").collect()}["a", 4] == 0.7
    assert rank.dense_scores(items, q.limit(0)).count() == 0


def test_stems():
    """Examples published with the algorithm."""
    words = "consigned consistency consolations consolidating conspicuously constables knackeries kneeling knives knocker knots generous communism skies dying early news inning hopping hoping feed agreed happily".split()
    stems = "consign consist consol consolid conspicu constabl knackeri kneel knive knocker knot generous communism sky die earli news inning hop hope feed agre happili".split()
    assert [*map(stem, words)] == stems


def test_bm25_with_stems_against_python(spark):
    docs = ["The runner was running in the gardens", "gardens garden gardening", "Ein Garten, ein Läufer и река", "nothing here"]
    passages = spark.createDataFrame(list(enumerate(docs)), "pid long, text string")
    queries = spark.createDataFrame([(1, "run in a garden"), (2, "река")], "qid int, question string")
    got = {(r.qid, r.pid): r.score for r in rank.bm25(passages, queries, 4, text.ENGLISH_STOPWORDS, tokens=rank.unicode_words, stems=True).collect()}
    words = [[stem(w) for w in re.findall(r"\b\w\w+\b", d.lower()) if w not in text.ENGLISH_STOPWORDS] for d in docs]
    mean, expected = sum(map(len, words)) / 4, {}
    for qid, terms in ((1, ["run", "garden"]), (2, ["река"])):
        for pid, w in enumerate(words):
            s = sum(math.log(1 + (4 - (df := sum(t in x for x in words)) + 0.5) / (df + 0.5)) * w.count(t) / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in terms if t in w)
            if s:
                expected[qid, pid] = round(s, 6)
    assert got == expected and (1, 1) in got and (2, 2) in got


def test_arm_names_and_guards(spark):
    names = [("out/subq_x_generated.json", {}), ("subq_x_raw_bytext.json", {}), ("subq_x_views3.json", {}), ("q.json", {}), ("subq_x_raw.json", {"path_gate": True, "window": 2}), ("subq_x_raw.json", {"path_gate": True, "reverse": True})]
    assert [retrieval.arm_of(n, **o) for n, o in names] == ["generated", "raw", "views3", "subq", "rawpathw2", "rawpathrev"]
    q = spark.createDataFrame([(1, "Who?"), (2, "What?"), (3, "When?"), (4, "Why?"), (5, "How?")], "qid int, question string")
    sets = spark.createDataFrame([("who", ["a?"]), ("other", ["b?"])], "qkey string, texts array<string>")
    with pytest.warns(UserWarning, match="under half"):
        joined = reports.checked_matches(matching.by_text(q, sets))
    assert {r.qid: r.texts for r in joined.collect()} == {1: ["a?"], 2: [], 3: [], 4: [], 5: []}
    with pytest.raises(reports.JoinFailure):
        reports.checked_matches(matching.by_text(q, sets.filter("qkey = 'other'")))
    by_id = spark.createDataFrame([(1, ["a?"]), (2, [])], "qid int, texts array<string>")
    assert [r.qid for r in reports.uncovered(q, by_id).orderBy("qid").collect()] == [2, 3, 4, 5] and reports.covered(by_id).count() == 1


def test_path_gates_and_passage_order(spark):
    """With a path, tier 1 is gated by rows 0 and 1 of the query set, tier 2 by rows 0 and 2."""
    seeds = spark.createDataFrame([(1, "a", 1.0)], "qid int, entity string, score double")
    mentions = spark.createDataFrame([("a", 10), ("b", 10), ("b", 11), ("c", 11)], "entity string, sentence int")
    gates = spark.createDataFrame([(1, 10, 0, 3, 0.1), (1, 10, 1, 3, 0.9), (1, 10, 2, 3, 1.0), (1, 11, 0, 3, 0.2), (1, 11, 1, 3, 1.0), (1, 11, 2, 3, 0.8)], "qid int, sentence int, j int, m int, gate double")
    got = {r.entity: (r.score, r.tier) for r in graph.spread(seeds, mentions, graph.table_gates(gates), 0.4).collect()}
    assert got == {"a": (1.0, 1), "b": (0.9, 2), "c": (0.72, 3)}
    assert graph.reversed_path(spark.createDataFrame([(1, ["x", "y"])], "qid int, texts array<string>")).first().texts == ["y", "x"]
    dense = spark.createDataFrame([(1, 7, 0.2), (1, 8, 0.6), (1, 9, 0.4)], "qid int, pid long, score double")
    bonus = spark.createDataFrame([(1, 9, 2.0)], "qid int, pid long, bonus double")
    weights = graph.passage_weights(dense, bonus)
    assert {r.pid: r.weight for r in weights.collect()} == {7: 0.0, 8: 0.075, 9: 0.1375}
    edges = spark.createDataFrame([("e:b", "p:7", 1.0), ("e:b", "p:9", 1.0)], "src string, dst string, w double")
    active = spark.createDataFrame([(1, "b", 0.9)], "qid int, entity string, score double")
    assert [r.pid for r in graph.passage_order(edges, active, weights, 3).orderBy("rank").collect()] == [9, 7, 8]
    ranked = spark.createDataFrame([(1, 0, 5)], "qid int, rank int, pid long")
    both = graph.with_fallback(ranked, spark.createDataFrame([(1, 0, 6), (2, 0, 7)], "qid int, rank int, pid long"), seeds)
    assert sorted(map(tuple, both.collect())) == [(1, 0, 5), (2, 0, 7)]


def test_traces_sinks_and_labels(spark, folder, tmp_path):
    with pytest.warns(UserWarning, match="no trace"):
        rows = retrieval.raw_traces(spark, [f"{folder}/trace.json", f"{folder}/none_gone.json"])
    gold = spark.createDataFrame([("1", "An E in it")], "id string, text string")
    assert [tuple(r) for r in graph.trace_report(rows, gold).collect()] == [("trace", 1, 0, 1.0, 1, 2.0, 1, 0)]
    path = retrieval.write_traces(rows, str(tmp_path), "run_x_raw")
    assert path.endswith("/trace_x_raw") and [r.arm for r in retrieval.raw_traces(spark, [path]).collect()] == ["raw"]
    done = retrieval.write_completions(spark.createDataFrame([("1", "q", "t", "stop")], "qid string, question string, text string, finish_reason string"), str(tmp_path / "raw"))
    assert done.count() == 1
    ranking = spark.createDataFrame([("1", 1, 5), ("1", 0, -1)], "qid string, rank int, pid long")
    path = retrieval.write_runs(ranking, str(tmp_path), "x")
    assert [tuple(r) for r in retrieval.runs(spark, [path]).collect()] == [("x", "1", [-1, 5])]
    retrieval.write_report(spark.createDataFrame([("overall", "", 2, 0.5, 1)], "section string, bucket string, k int, mean double, n long"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["mean"] == 0.5
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good").write_bytes(b"1\n1\n1 2\n")
    (tmp_path / "in" / "bad").write_bytes(b"1\r\n")
    assert {os.path.basename(r.path): r.status for r in retrieval.interval_files(spark, str(tmp_path / "in")).collect()} == {"good": "OK", "bad": "INVALID"}
    p = spark.createDataFrame([(0, "T", "x")], "pid long, title string, text string")
    q = spark.createDataFrame([("1", "q", "a", "s")], "qid string, question string, answer string, shape string")
    assert retrieval.exported_chunks(p).first().chunk == "T\nx" and retrieval.exported_questions(q, "d").first().question_type == "s"
    row = spark.createDataFrame([(2, True, " a, b?!", '["x", "", null]')], "n int, j boolean, t string, e string").select(text.bucket_label(F.col("n"), F.col("j")).alias("l"), text.cleaned(F.col("t")).alias("c"), graph.valid_entities(F.col("e")).alias("v")).first()
    assert tuple(row) == ("2hop-join", "a, b", ["x"])
