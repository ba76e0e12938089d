"""Near-duplicate groups by improved consistent weighted sampling.

A text is the weighted set of its five-word shingles: weight = occurrences x idf.  Each of BANDS x ROWS
samples picks a shingle consistently with the weights, so two texts agree in a sample with a probability
that equals their weighted Jaccard similarity.  Texts that agree in a whole band are candidates, and
candidates are verified by their exact weighted Jaccard similarity.

Document frequencies are counted over all documents in DF_BUCKETS hashed shingle features, a table of fixed
size at every scale: idf = 1 + ln((1 + N) / (1 + df)) / ln(DF_BUCKETS), so weights of rare and common
shingles differ by less than a factor of two and edits to many copies of a text don't outweigh what the
copies share.  A feature's share of the documents depends on the length of texts and not on their number: a text of 500 shingles touches
0.2 % of the features, so a shingle that more documents than that share is told apart at every size of the corpus.

Equal texts are one class, found by digest; only one text of a class is compared.  First all members of a band's
bucket are compared with the one that has most bucket mates (an original has more than its edited copies), which
joins nearly all of a family.  In a bucket that these links leave in several groups, every member outside the largest
group is then compared with every member of another group.  That goes by blocks: members are dealt to blocks of about BLOCK_BYTES, those
that ask to parts of about ASK_BYTES, and a task compares one part with one block through an index of the block's
shingles.  So nothing is capped, no bucket emits its pairs, and texts move once for each block and not for each pair.
Of the links that a member has into one group a block reports one, which is all that groups need.

Edge cases: null and wordless texts are never duplicates of another; a text of fewer than five words has one
shingle of all its words; rows with a null doc_id are kept and have no class; a repeated doc_id with equal
text has a row for each of its rows, all with the same keep; one with different texts has a decision for each text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.text import SLICE_BYTES, Words, mixed, slices, utf8
from quillspark.llm.work import fresh, stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
DF_BITS = 18
DF_BUCKETS = 1 << DF_BITS
#: Bytes of text, about, that a block of members and a part of those compared with it hold; one longer text is a block alone.
BLOCK_BYTES, ASK_BYTES = 1 << 19, 1 << 19
#: Entries of the table of gamma and uniform draws that a shingle's hash picks from, and shingles sampled at a time.
_DRAWS, _CHUNK = 1 << 16, 1 << 15
#: How far above its expected logarithm a minimum may lie before all shingles of its text are looked at.
_MARGIN = 2.0
_ID_BITS = 44


def _draw_table() -> np.ndarray:
    """Rows r, beta, q = ln c - r with r, c ~ Gamma(2, 1) and beta ~ Uniform(0, 1), by ascending q."""
    rng = np.random.default_rng(20100615)
    r, beta, c = rng.gamma(2, 1, _DRAWS), rng.random(_DRAWS), rng.gamma(2, 1, _DRAWS)
    q = np.log(c) - r
    return np.stack([r, beta, q])[:, np.argsort(q)].astype("<f4")


_R, _BETA, _Q = _draw_table()
_RNG = np.random.default_rng(41)
_FLIPS, _MULTIPLIERS = _RNG.integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
_MULTIPLIERS |= np.uint32(1)


def _sets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingle ids of each text in order, their occurrences, and bounds by text.  An id is the hash's upper 44 bits."""
    s, bounds = words.shingles(words.hashes(), SHINGLE)
    n = len(bounds) - 1
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds))
    keys = np.sort((text << np.uint64(_ID_BITS)) | (s >> np.uint64(64 - _ID_BITS)))
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    kept = keys[at]
    edges = np.searchsorted(kept, np.arange(n + 1, dtype=np.uint64) << np.uint64(_ID_BITS))
    return kept & np.uint64((1 << _ID_BITS) - 1), np.diff(np.append(at, len(keys))), edges


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(_ID_BITS - DF_BITS)).astype(np.int64)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Occurrences of each hashed shingle feature over the shingle sets of all documents, and their number."""

    def run(batches):
        totals, docs = np.zeros(DF_BUCKETS, np.int64), 0
        for b in batches:
            for first, end, data, offsets in slices(b.column(0)):
                totals += np.bincount(_bucket(_sets(Words(data, offsets))[0]), minlength=DF_BUCKETS)
                docs += end - first
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(totals[used], docs))], ["bucket", "n"])

    got = rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # DF_BUCKETS + 1 rows at most
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(DF_BUCKETS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def idf_weights(df: np.ndarray, docs: int) -> np.ndarray:
    """Features that large texts share by chance can have counts above the number of documents; they weigh 1."""
    return (1 + np.log(np.maximum((1 + docs) / (1 + df), 1)) / np.log(DF_BUCKETS)).astype("<f4")


def _ln_a(draw: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sample's value for a shingle and its quantised weight: t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r."""
    r, beta = _R[draw], _BETA[draw]
    t = np.floor(ln_w / r + beta)
    return _Q[draw] - r * (t - beta), t


def band_keys(words: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key for each band of each text with words, which texts these are, and their total weights.

    A sample is the shingle with the least a.  As ln a >= q - ln w and the least a of a text of total weight
    W is about 1 / W, only shingles with q - ln w up to a limit above -ln W are looked at; where the least
    value found lies above the limit, which is rare, all are.
    """
    s, tf, bounds = _sets(words)
    weight = (tf * idf[_bucket(s)]).astype("<f4")
    logs = np.log(weight)
    texts = np.flatnonzero(np.diff(bounds))
    edges = bounds[np.append(texts, texts[-1] + 1)] if len(texts) else np.zeros(1, np.int64)
    totals = np.add.reduceat(weight.astype(float), edges[:-1]) if len(texts) else np.zeros(0)
    h32 = (mixed(s) >> np.uint64(32)).astype(np.uint32)
    samples = np.zeros((len(texts), BANDS * ROWS), np.uint64)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(edges, edges[first] + _CHUNK, "right")) - 1)
        a, z = edges[first], edges[end]
        h, ln_w, at = h32[a:z], logs[a:z], edges[first:end] - a
        lengths = np.diff(np.append(at, z - a))
        limit = (-np.log(totals[first:end]) + _MARGIN).astype("<f4")
        cut = np.repeat(np.searchsorted(_Q, limit + np.maximum.reduceat(ln_w, at), "right").clip(1, _DRAWS - 1).astype(np.uint16), lengths)
        for k in range(BANDS * ROWS):
            draw = (((h ^ _FLIPS[k]) * _MULTIPLIERS[k]) >> np.uint32(16)).astype(np.uint16)
            looked = np.flatnonzero(draw < cut)
            start = np.searchsorted(looked, at)
            value, t = _ln_a(draw[looked], ln_w[looked])
            n = np.diff(np.append(start, len(looked)))
            least = np.full(len(at), np.inf, "<f4")
            some = np.flatnonzero(n)
            if len(some):
                least[some] = np.minimum.reduceat(value, start[some])
            hit = np.flatnonzero(value == np.repeat(least, n))
            place = np.zeros(len(at), np.int64)
            place[some] = hit[np.searchsorted(hit, start[some])]  # the first, in order of ids
            chosen, level = np.zeros(len(at), np.uint64), np.zeros(len(at))
            chosen[some], level[some] = s[a:z][looked[place[some]]], t[place[some]]
            for i in np.flatnonzero(least >= limit):
                every = slice(at[i], at[i] + lengths[i])
                value, t = _ln_a(draw[every], ln_w[every])
                j = int(np.argmin(value))
                chosen[i], level[i] = s[a:z][every][j], t[j]
            samples[first:end, k] = mixed(chosen ^ mixed(level.astype(np.int64).astype(np.uint64) + np.uint64(k << 32)))
        first = end
    keys = np.zeros((len(texts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, j::ROWS])
    return keys, texts, totals


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger ones; sets are sorted hashes with weights."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


def _pair_similarities(batch: pa.RecordBatch, idf: np.ndarray) -> np.ndarray:
    """Similarities of the texts of each row's nodes; the set of a node is made once."""
    u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    nodes, at, which = np.unique(np.concatenate([u, v]), return_index=True, return_inverse=True)
    column = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(at))
    s, tf, bounds = _sets(Words(*utf8(column)))
    w = tf * idf[_bucket(s)].astype(float)
    one = lambda i: (s[bounds[i] : bounds[i + 1]], w[bounds[i] : bounds[i + 1]])
    return np.array([weighted_jaccard(one(a), one(b)) for a, b in zip(which[: len(u)], which[len(u) :], strict=True)])


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """The pairs (u, v) whose texts have the similarity; a text of many pairs is split by the join."""
    a = texts.select(F.col("node").alias("u"), F.col("text").alias("left_text"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("right_text"))

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy().astype(np.int64))
            first = 0
            while first < batch.num_rows:  # few long texts or many short ones at a time
                base = sizes[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, "right")))
                part = batch.slice(first, end - first)
                yield part.select(["u", "v"]).filter(pa.array(_pair_similarities(part, idf) >= SIMILARITY))
                first = end

    joined = pairs.join(a, "u").join(b, "v").select("u", "v", "left_text", "right_text")
    return joined.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, label for each linked node: the least node of its component.

    A round takes the least label of the neighbours, then that of the label itself; it is written, so a
    lost executor repeats no earlier round.  The number of rounds grows with the logarithm of a chain.
    """
    both = stored(links.select("u", "v").union(links.select("v", "u")).toDF("u", "v").distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("m"))
        own = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        step = stored(own, "labels")
        jump = step.select(F.col("node").alias("j"), F.col("label").alias("jl"))
        labels = stored(step.join(jump, F.col("label") == F.col("j")).select("node", "was", F.least("label", "jl").alias("label")), "labels")
        if not labels.filter("label <> was").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def _groups(batches, keys: int):
    """The rows of equal values in the first ``keys`` columns, from batches in order of these."""
    key, held = None, []
    for b in batches:
        k = np.stack([b.column(i).to_numpy() for i in range(keys)], 1)
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)]
        for x, y in itertools.pairwise(edges):
            if y > x:
                if held and tuple(k[x]) != key:
                    yield pa.concat_batches(held)
                    held = []
                key = tuple(k[x])
                held.append(b.slice(x, y - x))
    if held:
        yield pa.concat_batches(held)


def block_links(asks: np.ndarray, labels: np.ndarray, texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Pairs of different labels that a similar text of each links: rows that ask against the others, one pair for each row and label."""
    if asks.all() or not asks.any():
        return np.zeros((0, 2), np.int64)
    _, _, data, offsets = next(slices(texts, 1 << 62))
    s, tf, bounds = _sets(Words(data, offsets))
    w = tf * idf[_bucket(s)].astype(float)
    sizes = np.diff(bounds)
    sums = np.concatenate([[0.0], np.cumsum(w)])
    totals = sums[bounds[1:]] - sums[bounds[:-1]]
    row = np.repeat(np.arange(len(sizes)), sizes)
    entries = np.flatnonzero(~asks[row])
    entries = entries[np.argsort(s[entries], kind="stable")]
    shingles, owners, weights = s[entries], row[entries], w[entries]
    found = []
    for q in np.flatnonzero(asks):
        own = slice(bounds[q], bounds[q + 1])
        low = np.searchsorted(shingles, s[own], "left")
        n = np.searchsorted(shingles, s[own], "right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owners[at], np.minimum(weights[at], np.repeat(w[own], n)), len(sizes))
        near = np.flatnonzero((shared > 0) & (shared >= SIMILARITY * (totals + totals[q] - shared)) & (labels != labels[q]))
        found += [(labels[q], x) for x in np.unique(labels[near])]
    return np.array(found, np.int64).reshape(-1, 2)


def _open_buckets(rest: DataFrame) -> DataFrame:
    """bucket, top (the label of most members) and the numbers of blocks and parts, for one of the buckets of equal members in several groups."""
    groups = rest.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("sign"))
    whole = groups.groupBy("bucket").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor("sign").alias("sign"), F.max(F.struct("n", "label", "bytes")).alias("top")).filter("groups > 1")
    parts = lambda size, most, name: F.ceil(size / F.lit(most)).cast("long").alias(name)
    one = whole.groupBy("sign", "n", "bytes").agg(F.min("bucket").alias("bucket"), F.first("top").alias("top"))  # equal members have equal groups
    return one.select("bucket", F.col("top.label").alias("top"), parts(F.col("bytes"), BLOCK_BYTES, "blocks"), parts(F.col("bytes") - F.col("top.bytes"), ASK_BYTES, "parts"))


def _remaining_links(rest: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """u, v: labels that similar texts link, of all members of one bucket with different labels.  rest: bucket, node, label, size."""
    rows = stored(rest.join(stored(_open_buckets(rest), "open"), "bucket").join(texts.select("node", "text"), "node"), "open-members")
    deal = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["bucket", "block", "part", "asks", "label", "text"]
    members = rows.withColumn("block", deal(1, F.col("blocks"))).withColumn("part", each("parts")).withColumn("asks", F.lit(False)).select(columns)
    asking = rows.filter("label <> top").withColumn("part", deal(2, F.col("parts"))).withColumn("block", each("blocks")).withColumn("asks", F.lit(True)).select(columns)
    keys = ["bucket", "block", "part"]
    dealt = members.union(asking).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        for g in _groups(batches, 3):
            links = block_links(g.column(3).to_numpy(zero_copy_only=False), g.column(4).to_numpy(), g.column(5), idf)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_groups(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """node, label for each text in a group of two or more: the least node of its group.  texts: stored node, text, a row for each node."""

    def sample(batches):
        for b in batches:
            for first, end, data, offsets in slices(b.column(1)):
                keys, which, totals = band_keys(Words(data, offsets), idf)
                nodes = b.column(0).slice(first, end - first).to_numpy(zero_copy_only=False)[which]
                sizes = np.diff(offsets)[which]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, BANDS), pa.int64()), pa.array(np.repeat(totals, BANDS)), pa.array(np.repeat(sizes, BANDS), pa.int64()), pa.array((keys ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64).ravel())], ["node", "weight", "size", "bucket"])

    bands = stored(texts.select("node", "text").mapInArrow(sample, "node long, weight double, size long, bucket long"), "bands")
    shared = stored(bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = stored(bands.join(shared, "bucket"), "members")
    mates = stored(members.groupBy("node").agg(F.sum("n").alias("mates")), "mates")
    active = stored(members.join(mates, "node").select("bucket", "node", "weight", "size", "mates"), "active")
    chosen = active.groupBy("bucket").agg(F.max(F.struct("mates", -F.col("node"), "weight")).alias("c")).select("bucket", (-F.col("c.col2")).alias("c_node"), F.col("c.weight").alias("c_weight"))
    others = stored(active.drop("mates").join(stored(chosen, "chosen"), "bucket").filter("node <> c_node"), "others")
    # the similarity is at most the quotient of the total weights
    near = F.least("weight", "c_weight") >= F.greatest("weight", "c_weight") * (SIMILARITY - 1e-6)
    pairs = stored(others.filter(near).select(F.least("node", "c_node").alias("u"), F.greatest("node", "c_node").alias("v")).distinct(), "pairs")
    labels = components(stored(verified(pairs, texts, idf), "links"))
    rest = stored(others.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"), "size"), "rest")
    more = components(stored(_remaining_links(rest, texts, idf), "links")).toDF("m_node", "m_label")
    joined = labels.join(more, F.col("label") == F.col("m_node"), "left").select("node", F.coalesce("m_label", "label").alias("label"))
    return joined.union(more.join(labels, F.col("m_node") == F.col("node"), "left_anti"))


def _digest() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)


def _decided(docs: DataFrame) -> DataFrame:
    """doc_id, digest, class_id, group_id, keep for each row.  Nodes are numbers of distinct texts, so rows of one doc_id with
    different texts are told apart; the text of a group that stays is the least by class_id and digest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df, n = document_frequencies(rows)
    idf = idf_weights(df, n)
    worded = F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]") & F.col("doc_id").isNotNull()
    digests = stored(rows.select("doc_id", _digest().alias("digest"), worded.alias("worded")), "digests")
    by_text = digests.filter("worded").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    classes = stored(by_text.withColumn("node", F.monotonically_increasing_id()), "classes")
    heads = classes.select("digest", F.col("class_id").alias("doc_id"), "node")
    texts = stored(rows.withColumn("digest", _digest()).join(heads, ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"]).select("node", "text"), "texts")
    members = stored(near_groups(texts, idf).join(classes.drop("n"), "node"), "group-members")
    firsts = members.groupBy("label").agg(F.min(F.struct("class_id", "digest")).alias("head"))
    info = members.join(firsts, "label").select("node", F.col("head.class_id").alias("group_id"), (F.col("digest") == F.col("head.digest")).alias("is_head"))
    known = classes.join(stored(info, "groups"), "node", "left").filter("n > 1 or group_id is not null").select(F.col("digest").alias("known"), "class_id", "group_id", "is_head")
    # rows without words stand alone; they stay out of the join, where they would share one key
    grouped = digests.filter("worded").join(known, F.col("digest") == F.col("known"), "left").drop("known")
    none = (F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("group_id"), F.lit(None).cast("boolean").alias("is_head"))
    every = grouped.unionByName(digests.filter(~F.coalesce("worded", F.lit(False))).select("*", *none))
    ids = every.select("doc_id", "digest", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "class_id", "doc_id").alias("group_id"), F.coalesce("is_head", F.lit(True)).alias("is_head"))
    keep = F.coalesce((F.col("doc_id") == F.col("group_id")) & F.col("is_head"), F.lit(True))
    return ids.select("doc_id", "digest", "class_id", "group_id", keep.alias("keep"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each document: class_id (least doc_id with the same text), group_id (least class of the near-duplicate
    group), keep (the one document of its group that stays)."""
    return _decided(docs).drop("digest")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, all columns kept; of rows that repeat doc_id and text one stays, rows with a null doc_id all stay."""
    decided = stored(_decided(docs).select("doc_id", "digest", "keep"), "decided")
    row_id, row_digest = fresh(docs, "row_id"), fresh(docs, "row_digest")
    same = (F.col("doc_id").cast("long") == F.col(row_id)) & (_digest() == F.col(row_digest))
    named = lambda rows: rows.select(F.col("doc_id").alias(row_id), F.col("digest").alias(row_digest))
    kept = docs.join(named(decided.filter("not keep")), same, "left_anti")
    repeated = stored(named(decided.filter("keep and doc_id is not null").groupBy("doc_id", "digest").count().filter("count > 1")), "repeated")
    if not repeated.limit(1).count():
        return kept
    one = kept.join(repeated, same).dropDuplicates([row_id, row_digest]).select(docs.columns)
    return kept.join(repeated, same, "left_anti").union(one)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
