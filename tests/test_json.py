"""JSON arrays read in blocks against a parser of the whole file."""

import json
import random

import pytest

from quillspark.sources import jsonarray, retrieval


def written(tmp_path, text):
    path = str(tmp_path / "a.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "日", "a", "\n", "\\\\"]) for _ in range(rng.randrange(12)))
    if kind < 4:
        return rng.choice([None, True, -1.5e3, 0, 12345])
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f'k"{i}\\': value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("split", [1, 2, 3, 7, 64, 100_000])
def test_elements_at_any_split(spark, tmp_path, split):
    rng = random.Random(split)
    items = [value(rng) for _ in range(12 if split < 4 else 60)]
    path = written(tmp_path, "\n " + json.dumps(items, ensure_ascii=split % 2 == 0, indent=rng.choice([None, 1])) + " \n")
    if split < 3:
        with open(path) as f:
            assert len(f.read()) < 3000
    got = {r.ord: json.loads(r.value) for r in jsonarray.elements(spark, path, split * (1 if split > 3 else 20)).collect()}
    assert got == dict(enumerate(items))


def test_marks_of_any_split_agree(tmp_path):
    """States carried over from bytes to bytes, a block being a single byte at times, without Spark."""
    rng = random.Random(4)
    for _ in range(40):
        items = [value(rng) for _ in range(rng.randrange(6))]
        data = json.dumps(items, ensure_ascii=False).encode()
        path = written(tmp_path, data.decode())
        for size in (1, 2, 5, 1000):
            begins, ends, inside, depth = [], [], False, 0
            for at in range(0, len(data), size):
                m = jsonarray._Marks(*jsonarray._part(path, at, size))
                e, b = m.bounds(inside, depth)
                ends += (e + at).tolist()
                begins += (b + at).tolist()
                depth += int(m.step[m.outside(inside)].sum())
                inside ^= bool(m.n_quotes % 2)
            assert [json.loads(data[a:z]) for a, z in zip(begins, ends) if data[a:z].strip()] == items and not inside and depth == 0


def test_empty_and_other_values(spark, tmp_path):
    for text in ("[]", " [ \n]", '{"a": [1]}', "", "3", '"[1]"'):
        assert jsonarray.elements(spark, written(tmp_path, text), 3).count() == 0


def test_a_corpus_has_the_same_positions_at_any_split(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = [{"title": f't"{i % 5}', "text": "".join(rng.choice('ab "\\,]}é') for _ in range(rng.randrange(40)))} for i in range(200)]
    path = written(tmp_path, json.dumps(rows))
    seen = set()
    for split in (211, 1 << 20):
        monkeypatch.setattr(jsonarray, "SPLIT", split)
        df = retrieval.corpus(spark, path)
        seen.add(tuple(sorted((r.pid, r.title, r.text, r.key) for r in df.collect())))
    assert len(seen) == 1 and [(r[1], r[2]) for r in sorted(next(iter(seen)))] == [(r["title"], r["text"]) for r in rows]
    assert df.rdd.getNumPartitions() == 1
    texts = ["a", 'b"', "c,\\"]
    assert [tuple(r) for r in retrieval.chunks(spark, written(tmp_path, json.dumps(texts))).orderBy("pid").collect()] == [(i, t, f"{i}:{t}") for i, t in enumerate(texts)]
