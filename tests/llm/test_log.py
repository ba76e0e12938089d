"""Transaction log reassembly against a plain forward replay."""

import random
import zlib

import pytest

from quillspark.llm import txlog
from quillspark.llm.txlog import ABORT, CHANGE, COMMIT, ROLLBACK, SAVEPOINT
from tests.llm.cases import documents, empty

LOG = "place long, lane string, tie long, kind int, key long, value long"


def replayed(log, epoch):
    """(fates, states) of a log, record by record with a real store and real savepoints."""
    store, lanes, commits, fates, states = {}, {}, 0, [], []
    last = None
    for place, lane, tie, kind, key, value in sorted((r for r in log if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2], r[3])):
        changes, saves = lanes.setdefault(lane, ([], []))
        if kind == CHANGE:
            changes.append((place, key, value))
        elif kind == SAVEPOINT:
            saves.append(len(changes))
        elif kind == ROLLBACK:
            at = saves.pop() if saves else 0
            fates += [(p, k, v, ROLLBACK, place, None) for p, k, v in changes[at:]]
            del changes[at:]
        else:
            if kind == COMMIT:
                commits += 1
                for p, k, v in changes:
                    store[k] = v
                    if v is None:
                        del store[k]
                last = (len(store), sum(store.values()))
                if commits % epoch == 0:
                    states.append((commits // epoch, *last))
            fates += [(p, k, v, kind, place, commits if kind == COMMIT else None) for p, k, v in changes]
            lanes[lane] = ([], [])
    for changes, _ in lanes.values():
        fates += [(p, k, v, ABORT, None, None) for p, k, v in changes]
    if commits % epoch:
        states.append((commits // epoch + 1, *last))
    return fates, states


def checked(spark, log, epoch=64, parts=None):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if parts:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        fates, states = txlog.reassembled(spark.createDataFrame(log, LOG), epoch)
        got = sorted((tuple(r) for r in fates.select("place", "key", "value", "outcome", "by", "commit_no").collect()), key=str)
        after = sorted(tuple(r) for r in states.select("epoch", "n_keys", "total").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, wanted = replayed(log, epoch)
    assert got == sorted(want, key=str)
    assert after == wanted


def made(seed, n, lanes, weights, keys):
    rng = random.Random(seed)
    kinds = rng.choices([CHANGE, COMMIT, ABORT, SAVEPOINT, ROLLBACK], weights, k=n)
    places = rng.sample(range(-n, 3 * n), n)
    return [(p, rng.choice(lanes), 0, k, rng.randrange(keys), None if rng.random() < 0.2 else rng.randrange(1 << 32)) for p, k in zip(places, kinds)]


@pytest.mark.parametrize(
    "weights, lanes, parts, epoch",
    [
        ((10, 2, 1, 2, 2), ["a", "a", "a", "b", None, ""], "4", 5),
        ((5, 0.05, 0.02, 4, 3), ["hot"] * 9 + ["b"], "9", 2),  # transactions that reach over many ranges, deep levels
        ((5, 0, 0, 4, 4), ["one"], "7", 64),  # one transaction that only the log's end closes
        ((1, 5, 0, 3, 3), ["a", "b"], "3", 64),
    ],
)
def test_random_logs_equal_a_replay(spark, weights, lanes, parts, epoch):
    checked(spark, made(int(parts), 400, lanes, weights, 12), epoch, parts)


def test_borders_of_a_transaction_over_several_ranges(spark):
    log = [(i, "l", 0, SAVEPOINT if i % 3 == 0 else CHANGE, i % 5, i) for i in range(60)]
    log += [(60 + i, "l", 0, ROLLBACK if i % 2 == 0 else CHANGE, i % 5, i) for i in range(30)]
    checked(spark, [*log, (100, "l", 0, COMMIT, 0, 0)], 64, "11")


def test_more_ranges_than_records_ties_and_missing_places(spark):
    log = [(1, "a", 0, CHANGE, 7, 5), (1, "b", 0, CHANGE, 7, 6), (1, "b", 1, CHANGE, 7, None), (2, "a", 0, COMMIT, 0, 0), (2, "b", 0, COMMIT, 0, 0), (2, "b", 0, COMMIT, 0, 0), (None, "a", 0, CHANGE, 1, 1), (3, None, 0, CHANGE, 9, 1), (3, None, 0, CHANGE, 9, 1)]
    checked(spark, log, 1, "12")
    checked(spark, [], 64)


def test_documents_become_records(spark):
    docs = documents(spark, extra=[f"text {i}" for i in range(60)])
    labels = spark.createDataFrame([(20, 1), (20, 1), (21, 0), (None, 1), (30, None)], "doc_id long, toxic int")
    want = []
    for r in docs.collect():
        if r.doc_id is not None:
            h = zlib.crc32(str(r.doc_id).encode())
            kind = [COMMIT, COMMIT, ABORT, SAVEPOINT, SAVEPOINT, ROLLBACK, ROLLBACK, *[CHANGE] * 10][h % 17]
            key = h // 100 % 30000
            want.append((r.doc_id, r.source, kind, key, None if r.text is None or r.doc_id == 20 else zlib.crc32(f"{key}:{r.text}".encode())))
    got = txlog.documents_log(docs, labels).select("place", "lane", "kind", "key", "value").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert txlog.documents_log(empty(spark), labels.limit(0)).count() == 0
