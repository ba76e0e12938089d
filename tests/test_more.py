"""Range sorts, bootstrap in pieces, the model boundary, runs and corpus files."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import intervals, text
from quillspark.operators import metrics, rank
from quillspark.sources import retrieval


def sorted_in_turn(values, operations):
    a = list(values)
    for c, low, high in operations:
        a[low - 1 : high] = sorted(a[low - 1 : high], reverse=c != 1)
    return a


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_range_sorts_equal_plain_sorting(data):
    n = data.draw(st.integers(1, 30))
    values = data.draw(st.one_of(st.permutations(range(n)), st.lists(st.integers(0, 5), min_size=n, max_size=n)))
    ops = []
    for _ in range(data.draw(st.integers(0, 12))):
        low = data.draw(st.integers(1, n))
        ops.append((data.draw(st.integers(1, 2)), low, data.draw(st.integers(low, n))))
    x = data.draw(st.sampled_from([*values, 99]))
    final = sorted_in_turn(values, ops)
    assert intervals.place_of(values, ops, x) == (final.index(x) + 1 if x in final else None)
    classes = [(v > x) - (v < x) + 1 for v in values]
    runs = intervals.ClassRuns(np.array(classes))
    for c, low, high in ops:
        runs.sort(low - 1, high, c == 1)
    assert np.array(runs).tolist() == sorted_in_turn(classes, ops)


def test_large_range_sorts_take_seconds():
    rng = random.Random(1)
    n = 200_000
    values = rng.sample(range(n), n)
    ops = []
    for _ in range(n):
        low = rng.randrange(1, n + 1)
        ops.append((rng.randrange(1, 3), low, min(n, low + int(rng.paretovariate(0.4)))))
    began = time.time()
    assert 1 <= intervals.place_of(values, ops, n // 2) <= n
    assert time.time() - began < 30


def test_no_values_and_absent_ones(spark):
    rows = [(1, [], [], 3), (2, [5, 3, 4], [(1, 1, 3), (2, 1, 2)], 3), (3, [1], [], 9)]
    df = spark.createDataFrame(rows, "id int, v array<int>, ops array<struct<c int, l int, r int>>, x int")
    assert {r.id: r.p for r in df.select("id", intervals.place_after(F.col("v"), F.col("ops"), F.col("x")).alias("p")).collect()} == {1: None, 2: 2, 3: None}


@pytest.mark.parametrize("n, piece", [(2, 5), (37, 100), (1000, 1 << 12), (1000, 1)])
def test_bootstrap_in_pieces_has_the_same_bits(monkeypatch, n, piece):
    x = np.random.default_rng(9).random(n)
    draws = np.random.default_rng(0).integers(0, n, size=(2000, n))
    want = tuple(float(v) for v in np.quantile(x[draws].mean(axis=1), [0.025, 0.975]))
    monkeypatch.setattr(metrics, "DRAWN", piece)
    assert metrics.bootstrap_interval(x) == want


def test_bootstrap_of_a_million_values_in_bounded_memory():
    x = np.random.default_rng(9).random(1_000_000)
    tracemalloc.start()
    low, high = metrics.bootstrap_interval(x, n=40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert low < x.mean() < high and peak < 100 << 20


def test_delta_table_draws_in_the_order_of_positions(spark):
    rng = np.random.default_rng(2)
    base, more = rng.random(30).round(3), rng.random(30).round(3)
    names = [f"q{v}" for v in rng.permutation(30)]
    rows = [(arm, names[i], i, 5, float(v), 2, False, "s" if i else "alone") for arm, vs in (("a", base), ("b", more)) for i, v in enumerate(vs)]
    recalls = spark.createDataFrame(rows, "arm string, qid string, ord int, k int, recall double, n_hops int, is_join boolean, shape string")
    made = {(r.section, r.bucket): r for r in metrics.full_delta_table(recalls, "a", order="ord").collect()}
    low, high = metrics.bootstrap_interval(more - base)
    assert (made["all", "all"].lo, made["all", "all"].hi) == pytest.approx((low, high), abs=1e-12)
    alone = made["question type", "alone"]
    assert alone.n == 1 and alone.star is False and metrics.marked(alone.delta, 0.0, 0.0, alone.n).endswith("(n<2)")
    shown = metrics.rendered_deltas(list(made.values()), 5)
    assert "depth x shape" in shown and "2hop-chain" in shown and "(n<2)" in shown and shown.splitlines()[0].split() == ["recall@5", "b"]


class Counting:
    """A scorer and encoder that leaves a file for each time that it is loaded, and notes the lengths that it sees."""

    def __init__(self, folder):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()

    def score(self, questions, passages):
        return [len(q.split()) * 1000 + len(p.split()) for q, p in zip(questions, passages, strict=True)]

    def encode(self, texts):
        assert [len(t) for t in texts] == sorted(len(t) for t in texts)
        return np.array([[len(t), 1.0] for t in texts], np.float32).reshape(-1, 2)


def test_models_load_once_a_task_and_see_cut_pairs(spark, tmp_path):
    import os

    folder = str(tmp_path / "loads")

    def make():
        return Counting(folder)

    rows = [(1, i, "q " * a, "p " * b) for i, (a, b) in enumerate([(3, 4), (10, 500), (500, 10), (300, 300), (192, 400), (0, 900)] * 300)]
    pairs = spark.createDataFrame(rows, "qid int, pid long, text string, passage string").repartition(3)
    got = {r.pid: r.score for r in rank.scored_pairs(pairs, make).collect()}
    want = [3004, 10374, 374010, 192192, 192192, 384]
    assert [got[i] for i in range(1800)] == want * 300
    assert len(os.listdir(folder)) == 3
    texts = spark.createDataFrame([(i, None if i == 3 else "x" * (i * 7 % 50)) for i in range(500)], "i int, text string").repartition(2)
    vectors = {r.i: r.embedding for r in rank.encoded(texts, make).collect()}
    assert len(os.listdir(folder)) == 5 and all(v == [0.0 if i == 3 else float(i * 7 % 50), 1.0] for i, v in vectors.items())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.integers(0, 60), st.integers(2, 50))
def test_joint_cut_takes_from_the_longer_side(a, b, limit):
    q, p = rank.joint_cut(list(range(a)), list(range(b)), limit)
    assert q == list(range(len(q))) and p == list(range(len(p))) and len(q) + len(p) == min(a + b, limit)
    if a + b > limit:
        assert len(q) == a or len(q) >= len(p) - 1
        assert len(p) == b or len(p) >= len(q)


def test_runs_of_both_forms_and_files_without_one(spark, tmp_path):
    (tmp_path / "run_x_raw.json").write_text('{"q1": [3, 1], "q2": []}')
    (tmp_path / "run_x_bad.json").write_text('[1, 2]')
    (tmp_path / "run_x_empty.json").write_text("{}")
    ranking = spark.createDataFrame([("q1", r, 50 - r) for r in range(12)] + [("q2", 0, 7)], "qid string, rank int, pid long")
    folder = retrieval.write_runs(ranking, str(tmp_path), "x_dense")
    with pytest.warns(UserWarning, match="no run in .*run_x_(bad|empty).json") as said:
        got = retrieval.runs(spark, [f"{tmp_path}/run_x_{n}.json" for n in ("raw", "bad", "empty")] + [folder])
    assert sum("no run in" in str(w.message) for w in said) == 2
    assert sorted(map(tuple, got.collect())) == [("dense", "q1", [50 - r for r in range(12)]), ("dense", "q2", [7]), ("raw", "q1", [3, 1]), ("raw", "q2", [])]
    assert retrieval.runs(spark, []).count() == 0


def test_a_corpus_as_files_and_back(spark, tmp_path):
    p = spark.createDataFrame([(0, "T", "x\ny"), (1, "U", "é")], "pid long, title string, text string")
    q = spark.createDataFrame([(0, "a", "Who?", "w", "s", [1, 0]), (1, "b", "What?", "v", "t", [])], "ord long, qid string, question string, answer string, shape string, gold array<bigint>")
    chunks, questions, gold = retrieval.read_corpus(spark, retrieval.write_corpus(p, q, str(tmp_path / "out"), "d"))
    assert sorted(map(tuple, chunks.collect())) == [(0, "T\nx\ny"), (1, "U\né")]
    assert [tuple(r) for r in questions.orderBy("ord").collect()] == [(0, "a", "Who?", "w", "d", "s", ""), (1, "b", "What?", "v", "d", "t", "")]
    assert [tuple(r) for r in gold.collect()] == [("a", [[0], [1]])]


def test_views_lose_white_space_inside_their_marks(spark):
    views = text.lexical_views("the old man saw foo\t, who built the green garden tower?")
    assert views[1:] == ["the old man saw foo", "built the green garden tower"]
    row = spark.createDataFrame([(" foo\t,",)], "t string").select(text.cleaned(F.col("t")).alias("c")).first()
    assert row.c == "foo"


@pytest.mark.parametrize("files, at_once", [(1 << 20, 1 << 21), (3, 5)])
def test_pagerank_of_hubs_over_many_files(spark, monkeypatch, files, at_once):
    from quillspark.operators import graph

    monkeypatch.setattr(graph, "EDGES_A_FILE", files)
    monkeypatch.setattr(graph, "EDGES_AT_A_TIME", at_once)
    rng = np.random.default_rng(files)
    edges = [("hub", f"n{i}", float(rng.integers(1, 5))) for i in range(40)] + [(f"n{i}", f"n{j}", 1.0) for i, j in rng.integers(0, 40, (30, 2))] + [("hub", "n1", 2.0)]
    names = sorted({x for e in edges for x in e[:2]} | {"alone"})
    place = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, w in edges:
        m[place[a], place[b]] += w
        m[place[b], place[a]] += w
    m /= np.maximum(m.sum(1, keepdims=True), 1e-300)
    reset = [(1, "hub", 1.0), (1, "alone", 3.0), (2, "n3", 2.0), (2, "n7", 0.5)]
    got = {(r.qid, r.node): r.score for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame(reset, "qid int, node string, weight double"), rounds=3).collect()}
    for q in (1, 2):
        r = np.zeros(len(names))
        for k, n, w in reset:
            r[place[n]] += w * (k == q)
        r /= r.sum()
        x = r
        for _ in range(3):
            x = 0.5 * r + 0.5 * x @ m
        assert all(abs(got.get((q, n), 0.0) - x[place[n]]) < 1e-7 for n in names)


def test_a_round_of_pagerank_is_one_exchange(spark):
    from quillspark.operators import graph

    plans = []
    for rounds in (1, 3):
        df = graph.pagerank(spark.createDataFrame([(1, 2, 1.0)], "src int, dst int, w double"), spark.createDataFrame([(1, 1, 1.0)], "qid int, node int, weight double"), rounds=rounds)
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
    assert plans[1] - plans[0] == 2


def test_folders_of_a_block_are_deleted_but_for_those_taken_out(spark):
    from quillspark.storage import kept, opened, shared_files, temporary

    with temporary() as made:
        first, second = kept(spark.range(3), "one"), kept(spark.range(4), "two")
        with temporary():
            kept(spark.range(5), "inner").count()
        folders = list(made)
        assert len(folders) == 2 and first.count() == 3
        made.remove(folders[1])
    gone, stays = (opened(f)[0].get_file_info(opened(f)[1]).type.name for f in folders)
    assert gone == "NotFound" and stays == "Directory" and second.count() == 4
    assert shared_files(folders[0]) == []
