"""Ranked search against plain scoring, its bitmap arithmetic against integers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import ranked
from tests.llm.cases import documents, empty, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def scored(docs, items, k):
    """Sorted (item_id, rank, doc_id, score)."""
    tfs = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in tfs if c), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in tfs:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_search_equals_plain_scores(spark, k):
    rng = random.Random(3)
    docs = documents(spark, extra=[prose(rng, rng.randrange(1, 60)) for _ in range(150)] + ["tie mint0"] * 40)
    items = [(1, "tie"), (2, prose(rng, 30)), (2, "One one éter3 ZEBRA"), (3, None), (4, ""), (5, "nowhere at all"), (None, "mint0 mint0 mint0 mint0 mint0 of1"), (6, "the1 " * 1000 + prose(rng, 200))]
    found = ranked.searched(docs.repartition(5), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got(found) == scored([(r.doc_id, r.text) for r in docs.collect()], items, k)


def test_blocks_and_query_files_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEMS_A_FILE", 3)
    monkeypatch.setattr(ranked, "ITEMS_TOGETHER", 2)
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 500)
    rng = random.Random(4)
    docs = [(rng.randrange(-50, 50), prose(rng, rng.randrange(0, 40))) for _ in range(120)]
    items = [(i, prose(rng, rng.randrange(0, 25))) for i in range(11)]
    found = ranked.searched(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2), 4)
    assert got(found) == scored(docs, items, 4)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.searched(empty(spark), items).count() == 0
    assert ranked.searched(documents(spark), items.limit(0)).count() == 0


def test_bitmap_arithmetic_equals_integers():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 20, (7, 192))
    values[rng.random(values.shape) < 0.5] = 0
    maps = np.stack([np.packbits((values >> s) & 1 > 0, axis=1, bitorder="little").view(np.uint64) for s in range(20)])
    weights = np.array([0, 1, 2, 3, 1000, 16383, 20011])
    products = ranked.weighted(maps, weights)
    item, term, times = np.array([0, 0, 0, 1, 1, 3]), np.array([1, 5, 6, 2, 4, 3]), np.array([1, 3, 6, 1, 1, 9])
    sums = np.zeros((4, 192), np.int64)
    np.add.at(sums, item, values[term] * weights[term][:, None] * times[:, None])
    total = ranked.summed(products, 4, item, term, times, 40)
    unpacked = sum(np.unpackbits(total[s].view(np.uint8).reshape(4, -1), axis=1, bitorder="little").astype(np.int64) << s for s in range(40))
    assert (unpacked == sums).all()
    sums[1, :60] = sums[1, 60]  # ties
    total = np.stack([np.packbits((sums >> s) & 1 > 0, axis=1, bitorder="little").view(np.uint64) for s in range(40)])
    which, doc, score = ranked.top(total, 5)
    for i in range(4):
        best = [(d, s) for d, s in sorted(enumerate(sums[i].tolist()), key=lambda x: (-x[1], x[0]))[:5] if s > 0]
        assert sorted(zip(doc[which == i].tolist(), score[which == i].tolist())) == sorted(best)
