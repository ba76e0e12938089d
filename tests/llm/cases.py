"""Small tables with the awkward cases that every operator has to take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, n long, digest string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "ration", "Ünder", "éter", "wheel", "garden", "to", "mint", "or", "sage", "42", "stone's"]) + str(rng.randrange(40)) for _ in range(n))


def documents(spark, extra=()):
    """Null, empty and wordless texts, ties, repeated rows, a long text and columns that clash with internal names."""
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split()
    near = list(words)
    near[150] = "changed"
    texts = [None, "", "   \n ", "one", "One ONE one.", base, base, " ".join(near), prose(rng, 20), "a  b   c\n\n  d \t e", "x<|endoftext|>y", "naïve café – “quoted” 日本語 text", prose(rng, 5_000), *extra]
    rows = [(i, t, "en", "src0", len(t or ""), "x", i, "d") for i, t in enumerate(texts)]
    rows.append(rows[5])
    rows.append((None, "no id here", None, None, None, None, None, None))
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]
