"""A family of thousands of near copies among other texts."""

import random

from quillspark.llm import near
from tests.llm.cases import prose


def test_a_family_of_thousands_leaves_one(spark):
    rng = random.Random(11)
    base = prose(rng, 120).split()
    family = []
    for i in range(3000):
        words = list(base)
        words[rng.randrange(len(words))] = f"edit{i}"  # any two share 106 of at most 126 shingles
        family.append(" ".join(words))
    others = [prose(rng, 90) for _ in range(150)]
    texts = family + others
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    kept = {r.text for r in near.deduplicated(docs).collect()}
    assert kept >= set(others) and len(kept) == len(others) + 1
