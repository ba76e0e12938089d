"""Substring dedup against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import repeats
from quillspark.llm.text import NOT_SPACE, Words, utf8
from tests.llm.cases import documents, empty, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(docs, width):
    """Sorted (doc_id, kept text, words, words removed, spans)."""
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    order = lambda i: (i is None, i or 0)
    for i, w in split:
        for p in range(len(w) - width + 1):
            s = tuple(w[p : p + width])
            least[s] = min(least.get(s, order(i)), order(i))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < order(i):
                gone |= set(range(p, p + width))
        spans = [p for p in sorted(gone) if p - 1 not in gone]
        spans = [(p, next(q for q in range(p, len(w) + 1) if q not in gone) - p) for p in spans]
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone), spans))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed, [tuple(s) for s in r.repeats]) for r in df.collect()), key=str)


def pool(seed, n, words):
    """Texts of few different words, with passages in common, so that anchors meet often in different surroundings."""
    rng = random.Random(seed)
    some = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    return [(rng.randrange(-20, 60), rng.choice(["\n", "  ", " \t"]).join(rng.choice(some) if rng.random() < 0.5 else prose(rng, rng.randrange(words)) for _ in range(rng.randrange(1, 6)))) for _ in range(n)]


@pytest.mark.parametrize("width, seed, block, parts", [(13, 5, 8 << 20, "4"), (13, 5, 700, "3"), (13, 13, 300, "2"), (6, 2, 1000, "7"), (5, 1, 400, "5")])
def test_removed_words_equal_brute_force(spark, monkeypatch, width, seed, block, parts):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = pool(width + block, 80, 40)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(int(parts))
        assert got(repeats.without_repeats(df, width, seed)) == cut(docs, width)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_awkward_documents(spark):
    rng = random.Random(9)
    shared = prose(rng, 51)
    docs = documents(spark, extra=[shared, f"{prose(rng, 9)} {shared} {prose(rng, 9)}", "the " * 400, "the " * 500, f"{shared}\n", "ù  é " * 30, prose(rng, 4000) + " " + shared])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(repeats.without_repeats(docs.repartition(4))) == cut([*rows], 13)
    assert repeats.without_repeats(empty(spark)).count() == 0


def test_a_group_of_thousands_of_copies(spark):
    rng = random.Random(2)
    text = prose(rng, 60)
    docs = [(i, text if i % 7 else f"{prose(rng, 5)} {text}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    found = got(repeats.without_repeats(df))
    assert found == cut(docs, 13)
    assert sum(r[3] for r in found) >= 2999 * 60


def test_a_common_line_in_front_of_different_words(spark, monkeypatch):
    monkeypatch.setattr(repeats, "OFTEN", 2)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 5000)
    rng = random.Random(3)
    line = prose(rng, 10)
    docs = [(i, f"{prose(rng, 8)} {line} {rng.choice('xy')} {prose(rng, 4)}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    n, split = repeats._ranges(repeats.blocks_of(df, 13, 5))
    assert 0 < len(repeats._loaded(split)) <= 8 * n
    assert got(repeats.without_repeats(df)) == cut(docs, 13)


def test_every_window_has_the_anchor_of_its_words():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(50)]
    data, offsets = utf8(pa.array(texts))
    words = Words(data, offsets, NOT_SPACE)
    w = repeats.Windows(words, np.arange(50), 13, 5)
    flat = [x for t in texts for x in t.split()]
    anchor = np.repeat(w.anchor, w.reach)
    known = {}
    assert len(w.start) == sum(max(0, len(t.split()) - 12) for t in texts) == w.reach.sum()
    for p, a, h in zip(w.start.tolist(), anchor.tolist(), w.hash.tolist()):
        assert known.setdefault(tuple(flat[p : p + 13]), (a, h)) == (a, h)
    assert len({h for _, h in known.values()}) == len(known)
    assert w.reach.max() <= 9


def test_a_task_has_one_block_in_memory(spark, monkeypatch):
    """a task got all blocks of its split in one batch of rows; now rows are paths, whose files are read one at a time."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    docs = pool(5, 80, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = repeats._paths(repeats.blocks_of(df, 13, 5)).toArrow()
    read, real = [], repeats.opened
    monkeypatch.setattr(repeats, "opened", lambda path: read.append(path) or real(path))
    found = []
    for i, row in enumerate(repeats._stored_rows(rows.combine_chunks().to_batches()), 1):
        assert len(read) == i and (len(row["texts"]) == 1 or sum(len(t.encode()) for t in row["texts"].to_pylist()) <= 2000)
        found += zip(row["doc_ids"].to_pylist(), row["texts"].to_pylist())
    assert len(read) > 5 and sorted(found) == sorted(docs)


@pytest.mark.parametrize("at_a_time", [1, 7, 1 << 19])
def test_repeats_of_a_range_in_pieces(monkeypatch, at_a_time):
    monkeypatch.setattr(repeats, "WINDOWS_AT_A_TIME", at_a_time)
    rng = np.random.default_rng(4)
    anchor, doc, reach = rng.integers(0, 9, 60).astype(np.uint64), rng.integers(0, 12, 60), rng.integers(1, 4, 60)
    window = rng.integers(0, 5, reach.sum())
    key = list(zip(np.repeat(anchor, reach).tolist(), window.tolist()))
    docs = np.repeat(doc, reach).tolist()
    least = {k: min(d for x, d in zip(key, docs) if x == k) for k in key}
    assert repeats.repeated(anchor, doc, reach, window).tolist() == [d > least[k] for k, d in zip(key, docs)]
