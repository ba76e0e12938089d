"""Activation spread over an entity-sentence graph and personalised PageRank.

The visible parts of the source method fix activation, pruning, tiers and bonuses; edge construction and the
combination of scores are choices of this library.  Loops write each round to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.rank import _best, min_max, top_k
from quillspark.operators.substrings import occurrences
from quillspark.storage import grouped_files, kept, read_arrow, shared_files, shared_folder, write_shared


def gate_rows(tier: Column, m: Column, width: int) -> Column:
    """Rows of the query set that gate tier t: the question and those within ``width`` of clamp(t, 1, m - 1); all when m < 2."""
    at = F.least(F.greatest(tier, F.lit(1)), m - 1)
    near = F.sequence(F.greatest(at - width, F.lit(1)), F.least(at + width, m - 1))
    return F.when(m < 2, F.sequence(F.lit(0), m - 1)).otherwise(F.concat(F.array(F.lit(0)), near))


Gates = Callable[[DataFrame, int], DataFrame]


def table_gates(gates: DataFrame, window: int = 0) -> Gates:
    """Gates from a table (qid, sentence, gate); or, where they follow a path, (qid, sentence, j, m, gate) of each row j of the m rows of
    the query set, of which tier t takes the best in ``gate_rows(t, m, window)``."""

    def gate(pairs: DataFrame, tier: int) -> DataFrame:
        now = gates.join(pairs, ["qid", "sentence"])
        if "j" in gates.columns:
            now = now.filter(F.array_contains(gate_rows(F.lit(tier), F.col("m"), window), F.col("j")))
        return now.groupBy("qid", "sentence").agg(F.max("gate").alias("gate"))

    return gate


#: Rows of a file of the frontier, vectors x sentences that are scored at a time, bytes of frontier files that a task keeps.
FRONTIER_A_FILE, SCORES_AT_A_TIME, FRONTIER_BYTES = 1024, 1 << 20, 32 << 20


class _Frontier:
    """A file of the frontier: for each row its query, entity, score, gating vectors and used sentences."""

    def __init__(self, rows: pa.Table):
        self.size = rows.nbytes
        entity, self.qids, self.scores, vectors, used = (c.combine_chunks() for c in rows.columns)
        coded = entity.dictionary_encode()
        codes = coded.indices.to_numpy()  # sorted by entity: a run for each
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        self.entities = entity.take(pa.array(first))
        self.bounds = np.append(first, len(codes))
        self.n = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        self.matrix = vectors.flatten().flatten().to_numpy(zero_copy_only=False).reshape(int(self.n.sum()), -1)
        self.ends = np.cumsum(self.n)
        n_used = pc.list_value_length(used).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used, self.used_ends = used.flatten(), np.cumsum(n_used)
        self.used_row = np.repeat(np.arange(len(codes)), n_used)

    def gates(self, low: int, high: int, x: np.ndarray, sentences: pa.Array, digits: int) -> np.ndarray:
        """The gates of rows low to high for sentences sorted by id, minus infinity for used ones."""
        start = self.ends[low] - self.n[low]
        dots = np.round(self.matrix[start : self.ends[high - 1]] @ x.T, digits)
        out = np.maximum.reduceat(dots, self.ends[low:high] - self.n[low:high] - start, axis=0)
        at = slice(self.used_ends[low - 1] if low else 0, self.used_ends[high - 1])
        if at.stop > at.start:
            coded = sentences.dictionary_encode()
            count = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            found = pc.index_in(self.used.slice(at.start, at.stop - at.start), value_set=coded.dictionary).fill_null(-1).to_numpy().astype(np.int64)
            known = found >= 0
            n = count[found[known]]
            column = np.repeat((np.cumsum(count) - count)[found[known]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[np.repeat(self.used_row[at][known] - low, n), column] = -np.inf
        return out


class VectorGates:
    """Gates that are scored when a round asks for them: the best inner product of a sentence (sentence, embedding) with the query set's
    vectors (qid, j, embedding), all of them, or with ``window`` those that the path gives to the tier.

    A sentence meets the queries that have one of its entities in their frontier.  The frontier is written to shared files by entity, a frequent
    one over several; tasks that read mentions score them against one file at a time and pass on only what is among the best so far of
    its query and entity, so what is shuffled follows frontier x tasks and not frontier x mentions."""

    def __init__(self, sentences: DataFrame, sets: DataFrame, window: int | None, digits: int):
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("j", F.col("embedding").cast("array<double>").alias("e")))), lambda x: x["e"])
        self.rows = kept(sets.filter("embedding is not null").groupBy("qid").agg(ordered.alias("rows")), "query-sets")  # as many vectors as a query set has
        self.sentences, self.window, self.digits = sentences.filter("embedding is not null").select("sentence", "embedding"), window, digits

    def best(self, frontier: DataFrame, mentions: DataFrame, used: DataFrame | None, tier: int, k: int) -> DataFrame:
        """(qid, entity, score, sentence, gate) that hold the ``k`` best unused sentences of each row (qid, entity, score) of the frontier."""
        wanted = F.sequence(F.lit(0), F.size("rows") - 1) if self.window is None else gate_rows(F.lit(tier), F.size("rows"), self.window)
        chosen = self.rows.select("qid", F.transform(wanted, lambda j: F.get("rows", j)).alias("rows"))
        none = F.array().cast(T.ArrayType(mentions.schema["sentence"].dataType))
        asked = frontier.join(chosen, "qid")
        if used is None:
            asked = asked.withColumn("used", none)
        else:
            asked = asked.join(used.groupBy("qid").agg(F.collect_set("sentence").alias("used")), "qid", "left").withColumn("used", F.coalesce("used", none))  # a few for each round
        folder = grouped_files(asked.select("entity", "qid", "score", "rows", "used"), "entity", ["qid"], FRONTIER_A_FILE, "frontier", whole=False)
        digits = self.digits
        fields = [*frontier.select("qid", "entity", "score").schema, mentions.schema["sentence"], T.StructField("gate", T.DoubleType())]

        def score(batches):
            names, held, room = shared_files(folder), {}, FRONTIER_BYTES
            entities: dict[str, pa.Array] = {}
            least: dict[str, np.ndarray] = {}

            def opened_file(name: str) -> _Frontier:
                nonlocal room
                if name in held:
                    return held[name]
                made = _Frontier(read_arrow(f"{folder}/{name}"))
                if made.size <= room:
                    held[name], room = made, room - made.size
                entities[name] = made.entities
                return made

            for b in batches:
                if not b.num_rows:
                    continue
                rows = pa.Table.from_batches([b]).sort_by([("entity", "ascending"), ("sentence", "ascending")]).combine_chunks()  # the first of equal gates is the smaller sentence
                x = rows.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                sentences, coded = rows.column(1).combine_chunks(), rows.column(0).combine_chunks().dictionary_encode()
                count = np.bincount(coded.indices.fill_null(len(coded.dictionary)).to_numpy(), minlength=len(coded.dictionary))
                first = np.cumsum(count) - count
                for name in names:
                    known = entities[name] if name in entities else opened_file(name).entities
                    here = pc.index_in(known, value_set=coded.dictionary).fill_null(-1).to_numpy().astype(np.int64)
                    if not (here >= 0).any():
                        continue
                    q = opened_file(name)
                    best = least.setdefault(name, np.full((len(q.qids), k), -np.inf))
                    for i in np.flatnonzero(here >= 0):
                        low, high = q.bounds[i], q.bounds[i + 1]
                        vectors = int(q.n[low:high].sum())
                        step = max(1, SCORES_AT_A_TIME // max(vectors, 1))
                        begin, end = first[here[i]], first[here[i]] + count[here[i]]
                        for at in range(begin, end, step):
                            some = slice(at, min(at + step, end))
                            g = q.gates(low, high, x[some], sentences.slice(at, some.stop - at), digits)
                            so_far = best[low:high]
                            keep = _best(g, k) & (g >= so_far[:, :1]) & (g > -np.inf)
                            row, col = np.nonzero(keep)
                            if len(row):
                                both = np.concatenate([so_far, np.where(keep, g, -np.inf)], axis=1)
                                best[low:high] = np.sort(np.partition(both, -k, axis=1)[:, -k:], axis=1)
                                places = pa.array(row + low)
                                name_of = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(row), np.int32)), q.entities.slice(i, 1)).dictionary_decode()
                                yield pa.RecordBatch.from_arrays([q.qids.take(places), name_of, q.scores.take(places), sentences.take(pa.array(col + at)), pa.array(g[row, col])], ["qid", "entity", "score", "sentence", "gate"])

        met = mentions.select("entity", "sentence").join(self.sentences, "sentence").select("entity", "sentence", "embedding")
        return met.mapInArrow(score, T.StructType(fields))


def vector_gates(sentences: DataFrame, sets: DataFrame, window: int | None = None, digits: int = 6) -> VectorGates:
    return VectorGates(sentences, sets, window, digits)


def spread(seeds: DataFrame, mentions: DataFrame, gates: Gates | VectorGates, threshold: float = 0.4, per_entity: int = 2, rounds: int = 3, digits: int = 6) -> DataFrame:
    """(qid, entity, score, tier, last_tier) after breadth-first activation.

    An active entity takes its ``per_entity`` best unused sentences by gate; each conducts once for a query, for the
    entity with the higher score and then the smaller name (a fixed owner, where the source goes entity by entity).
    Co-mentioned entities get entity score x gate, pruned below ``threshold``; scores that arrive later are added.
    A round asks ``gates`` for the unused sentences of its frontier's entities only, vector gates for the best of them.
    """
    first = seeds.select("qid", "entity", F.col("score").cast("double").alias("score"), F.lit(1).alias("tier"), F.lit(1).alias("last_tier"))
    active, frontier, used = kept(first), first.select("qid", "entity", "score"), None
    for t in range(2, rounds + 2):
        if isinstance(gates, VectorGates):
            options = gates.best(frontier, mentions, used, t - 1, per_entity)
        else:
            options = frontier.join(mentions, "entity")
            if used is not None:
                options = options.join(used, ["qid", "sentence"], "left_anti")
            options = kept(options, "options")
            options = options.join(gates(options.select("qid", "sentence").distinct(), t - 1), ["qid", "sentence"])
        best = W.partitionBy("qid", "entity").orderBy(F.col("gate").desc(), "sentence")
        own = W.partitionBy("qid", "sentence").orderBy(F.col("score").desc(), "entity")
        taken = options.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= per_entity)
        taken = kept(taken.withColumn("o", F.row_number().over(own)).filter("o = 1").select("qid", "sentence", F.col("entity").alias("source"), "score", "gate"))
        reached = taken.join(mentions, "sentence").filter("entity <> source").withColumn("s", F.col("score") * F.col("gate")).filter(F.col("s") >= threshold)
        new = kept(reached.groupBy("qid", "entity").agg(F.round(F.sum("s"), digits).alias("score")))
        if not new.limit(1).count():
            break
        merged = active.unionByName(new.select("qid", "entity", "score", F.lit(t).alias("tier"), F.lit(t).alias("last_tier")))
        active = kept(merged.groupBy("qid", "entity").agg(F.round(F.sum("score"), digits).alias("score"), F.min("tier").alias("tier"), F.max("last_tier").alias("last_tier")))
        used = taken.select("qid", "sentence") if used is None else used.union(taken.select("qid", "sentence"))
        frontier = new
    return active


def passage_bonus(active: DataFrame, passages: DataFrame, by_tier: bool = True) -> DataFrame:
    """(qid, pid, bonus): sum over active entities of score x ln(1 + occurrences) / last tier.  Occurrences are those of the lower-cased
    entity as a substring of the lower-cased passage, parts of words too, without overlap."""
    named = active.withColumn("pattern", F.lower("entity"))
    found = occurrences(passages.select("pid", F.lower("text")), named.select("pattern"))
    part = F.col("score") * F.log(1 + F.col("n")) / (F.col("last_tier") if by_tier else F.lit(1))
    return named.join(found.withColumnRenamed("id", "pid"), "pattern").groupBy("qid", "pid").agg(F.round(F.sum(part), 6).alias("bonus"))


def reversed_path(sets: DataFrame) -> DataFrame:
    """Control: (qid, texts) with the sub-questions in reverse; the question itself stays before them."""
    return sets.withColumn("texts", F.reverse("texts"))


def passage_weights(dense: DataFrame, bonus: DataFrame, ratio: float = 1.5, weight: float = 0.05) -> DataFrame:
    """(qid, pid, weight) of passage nodes: (ratio x pooled score, from 0 to 1 within a query, + bonus) x weight.  How the source
    adds them up isn't visible; the sum is this library's choice."""
    scaled = min_max(dense.select("qid", "pid", "score"))
    both = scaled.join(bonus, ["qid", "pid"], "full")
    return both.select("qid", "pid", F.round((ratio * F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))) * weight, 9).alias("weight"))


def passage_order(edges: DataFrame, active: DataFrame, passages: DataFrame, k: int, damping: float = 0.5, rounds: int = 5, digits: int = 9) -> DataFrame:
    """(qid, rank, pid, score): passages by PageRank from the weights of entities (qid, entity, score) and passages (qid, pid, weight).
    edges: src, dst, w between entities and passages; nodes are "e:" + entity and "p:" + pid.

    The scores are those of ``pagerank``, but passages with equal edges have equal scores for a query except where it gives them weights of their own. So the rounds
    know a class of such passages by its smallest one, beside it the weights of its members, and what is moved follows queries x classes and not queries x passages.
    The k best are among the weighted passages and the k smallest pids of the k best classes.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = edges.select("src", "dst", "w").union(edges.select("dst", "src", "w")).toDF("src", "dst", "w")
    key, pid = ["a", "b", "n_edges"], F.substring("node", 3, 40).cast("long").alias("pid")
    summed = both.filter(F.col("src").startswith("p:")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    hashes = (F.bit_xor(F.xxhash64(*salt, "dst", "w")) for salt in ((), (F.lit(1),)))
    signed = kept(summed.groupBy(F.col("src").alias("node")).agg(*(h.alias(c) for h, c in zip(hashes, "ab", strict=True)), F.count("*").alias("n_edges")).select(pid, *key), "signed")
    classes = kept(signed.groupBy(*key).agg(F.min("pid").alias("class"), F.count("*").alias("size")), "classes")
    name = F.concat(F.lit("p:"), F.col("class").cast("string"))
    folder = _store_shares(_class_shares(both, classes.select(name.alias("node"), "size")), n)

    entity = active.select("qid", F.concat(F.lit("e:"), "entity").alias("node"), F.lit(None).cast("long").alias("pid"), F.col("score").alias("weight"))
    reset = entity.union(passages.select("qid", F.concat(F.lit("p:"), F.col("pid").cast("string")), "pid", "weight")).filter("weight > 0")
    start = kept(reset.select("qid", "node", "pid", F.round(F.col("weight") / F.sum("weight").over(W.partitionBy("qid")), digits).alias("r")).groupBy("qid", "node", "pid").agg(F.sum("r").alias("r")))
    placed = start.filter("pid is not null").join(signed.join(classes, key).select("pid", name.alias("of"), "size"), "pid", "left").select("qid", F.coalesce("of", "node").alias("node"), F.coalesce("size", F.lit(1)).alias("size"), "pid", "r")
    placed = placed.union(start.filter("pid is null").select("qid", "node", F.lit(1), "pid", "r"))
    base = kept(placed.groupBy("qid", "node").agg(F.collect_list(F.struct("pid", "r")).alias("own"), F.max("size").alias("size")))  # a query's weights in one class
    none = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in ("own", "size")]

    def score(r: Column, t: int) -> Column:
        """Of a member with weight r after t rounds, from what flows to each member."""
        return F.round(r * (1 - damping) + F.col("flow"), digits) if t else r

    def mean(t: int) -> Column:
        rest = F.round("flow", digits)
        more = F.aggregate("own", F.lit(0.0), lambda total, x: total + score(x["r"], t) - rest)
        return rest + F.coalesce(more / F.col("size"), F.lit(0.0))

    state = base.withColumn("flow", F.lit(0.0)).withColumn("met", F.lit(False)).repartition(n, "node")
    for t in range(rounds):
        flow = _flow(state.select("qid", "node", mean(t).alias("x"), _part_of("node", n).alias("part")), folder, damping)
        moved = base.select("qid", "node", F.lit(None).cast("double").alias("x"), "own", "size").union(flow.select("qid", "node", "x", *none)).repartition(n, "node")
        state = moved.groupBy("qid", "node").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("flow"), F.count("x").alias("met"), F.first("own", ignorenulls=True).alias("own"), F.first("size", ignorenulls=True).alias("size"))
        state = state.withColumn("met", F.col("met") > 0)
    state = kept(state.filter(F.col("node").startswith("p:")), "classes")

    own = state.select("qid", "flow", F.explode("own").alias("x")).select("qid", "x.pid", score(F.col("x.r"), rounds).alias("score"))
    best = top_k(state.filter("met").select("qid", pid, F.round("flow", digits).alias("score")), k).select("qid", F.col("pid").alias("class"), "score")
    few = signed.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy("pid"))).filter(F.col("place") <= k).join(classes, key).select("class", "pid")
    found = best.join(few, "class").select("qid", "pid", "score").union(own).groupBy("qid", "pid").agg(F.max("score").alias("score"))  # an own weight only adds
    return top_k(found, k).select("qid", "rank", "pid", "score")


def _class_shares(both: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, dst, share) of the edges (src, dst, w), in both directions, between nodes that aren't passages and those that stand for a class (node, size): what a
    node gives to one member, what all members of a class together give to a node."""

    def known(rows: DataFrame, end: str) -> DataFrame:
        passage = F.col(end).startswith("p:")
        return rows.filter(~passage).union(rows.filter(passage).join(classes.select(F.col("node").alias(end)), end, "left_semi").select("src", "dst", "w"))

    total = both.groupBy("src").agg(F.sum("w").alias("total")).join(classes.withColumnRenamed("node", "src"), "src", "left")
    return known(known(both, "src"), "dst").join(total, "src").select("src", "dst", (F.col("w") / F.col("total") * F.coalesce("size", F.lit(1))).alias("share"))


#: Edges of a file of an edge block; edges that a task follows at a time.
EDGES_A_FILE, EDGES_AT_A_TIME = 1 << 20, 1 << 21


def _part_of(node: str, n: int) -> Column:
    """The partition to which ``repartition(n, node)`` sends a row."""
    return F.pmod(F.hash(node), F.lit(n))


def store_edges(edges: DataFrame, n: int) -> str:
    """A shared folder with the shares of undirected weighted edges (src, dst, w), in files by the partition of src and sorted by it.  A node's edges, however many,
    fill as many files as they need, so no task holds more than one file of a hub."""
    both = edges.select("src", "dst", "w").union(edges.select("dst", "src", "w")).toDF("src", "dst", "w")
    return _store_shares(both.join(both.groupBy("src").agg(F.sum("w").alias("total")), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), n)


def _store_shares(shares: DataFrame, n: int) -> str:
    folder = shared_folder(shares.sparkSession, "edges")

    def write(batches):
        held, k, part = [], 0, None

        def put(rows: pa.Table) -> None:
            nonlocal k
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema) as f:
                f.write_table(rows)
            write_shared(f"{folder}/{part}/{k:06d}.arrow", out.getvalue().to_pybytes())
            k += 1

        for b in batches:
            if b.num_rows:
                part = b.column(3)[0].as_py()
                held.append(b.select([0, 1, 2]))
            while sum(x.num_rows for x in held) >= EDGES_A_FILE:
                rows = pa.Table.from_batches(held)
                put(rows.slice(0, EDGES_A_FILE))
                held = rows.slice(EDGES_A_FILE).to_batches()
        if held:
            put(pa.Table.from_batches(held))
        yield from ()

    dealt = shares.withColumn("part", _part_of("src", n)).repartitionById(n, F.col("part")).sortWithinPartitions("src", "dst")
    dealt.mapInArrow(write, "done boolean").write.format("noop").mode("overwrite").save()
    return folder


def _flow(scores: DataFrame, folder: str, damping: float) -> DataFrame:
    """What the nodes of (qid, node, x, part) give to their neighbours: (qid, node, x), added up as far as a task can."""
    schema = T.StructType([*scores.select("qid", "node").schema, T.StructField("x", T.DoubleType())])

    def send(qids: pa.Array, nodes: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        q, d = qids.dictionary_encode(), nodes.dictionary_encode()
        pairs = q.indices.to_numpy().astype(np.int64) * len(d.dictionary) + d.indices.to_numpy()
        known, place = np.unique(pairs, return_inverse=True)
        qi, di = np.divmod(known, max(len(d.dictionary), 1))
        return pa.RecordBatch.from_arrays([q.dictionary.take(pa.array(qi)), d.dictionary.take(pa.array(di)), pa.array(np.bincount(place, x, len(known)))], schema.names)

    def run(batches):
        held: dict[int, list[str]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(3)[0].as_py()
            if part not in held:
                held[part] = shared_files(f"{folder}/{part}")
            x = b.column(2).to_numpy()
            for name in held[part]:
                edges = read_arrow(f"{folder}/{part}/{name}")
                src = edges.column(0).combine_chunks()
                coded = src.dictionary_encode()
                count = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))  # sorted by src: a run for each
                first = np.cumsum(count) - count
                at = pc.index_in(b.column(1), value_set=coded.dictionary).fill_null(-1).to_numpy().astype(np.int64)
                rows = np.flatnonzero(at >= 0)
                dst, share = edges.column(1).combine_chunks(), edges.column(2).to_numpy()
                degree = count[at[rows]]
                low = 0
                while low < len(rows):
                    high = max(low + 1, low + int(np.searchsorted(np.cumsum(degree[low:]), EDGES_AT_A_TIME, "right")))
                    some, n = rows[low:high], degree[low:high]
                    edge = np.repeat(first[at[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    row = np.repeat(some, n)
                    yield send(b.column(0).take(pa.array(row)), dst.take(pa.array(edge)), x[row] * share[edge] * damping)
                    low = high

    return scores.select("qid", "node", "x", "part").mapInArrow(run, schema)


def pagerank(edges: DataFrame, reset: DataFrame, damping: float = 0.5, rounds: int = 5, digits: int = 9) -> DataFrame:
    """(qid, node, score) of personalised PageRank on undirected weighted edges (src, dst, w); reset: (qid, node, weight).

    A node without edges keeps its reset share only.  Edges are laid out once; a round moves scores only, by one exchange to the partition that has the node's edges.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = store_edges(edges, n)
    whole = W.partitionBy("qid")
    start = kept(reset.select("qid", "node", F.round(F.col("weight") / F.sum("weight").over(whole), digits).alias("r")))
    base = start.select("qid", "node", (F.col("r") * (1 - damping)).alias("x"))
    score = start.select("qid", "node", F.col("r").alias("x")).repartition(n, "node")
    for _ in range(rounds):
        flow = _flow(score.withColumn("part", _part_of("node", n)), folder, damping)
        score = base.union(flow).repartition(n, "node").groupBy("qid", "node").agg(F.round(F.sum("x"), digits).alias("x"))
    return score.withColumnRenamed("x", "score")


def with_fallback(ranked: DataFrame, dense: DataFrame, seeds: DataFrame) -> DataFrame:
    """The graph's ranking, and the dense one for queries without seeds."""
    return ranked.unionByName(dense.join(seeds.select("qid").distinct(), "qid", "left_anti"))


def tier_report(active: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Activations by tier; with gold (qid, text) how many are of entities in the query's gold text."""
    if gold is None:
        return active.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))
    named = active.withColumn("pattern", F.lower("entity"))
    found = occurrences(gold.select("qid", F.lower("text")), named.select("pattern")).select(F.col("id").alias("qid"), "pattern", F.lit(True).alias("hit")).distinct()
    one = named.join(found, ["qid", "pattern"], "left")
    return one.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.count_if(F.coalesce("hit", F.lit(False))).alias("gold_hits"))


def trace_report(traces: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each arm of entity traces (arm, id, seeded, used_sentences, entities of [text, tier, score]): questions, those that
    bypassed the graph, mean and most activations, mean sentences used, activations in the gold text (id, text) and those beyond the seeds."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    hits = lambda deep: F.size(F.filter("entities", lambda e: (lower != "") & F.contains(lower, F.lower(e["text"])) & (e["tier"] > 1 if deep else F.lit(True))))
    rows = traces.join(gold.select("id", "text"), "id", "left")
    return rows.groupBy("arm").agg(
        F.count("*").alias("questions"),
        F.count_if(~F.col("seeded")).alias("bypassed"),
        F.round(F.avg(F.size("entities")), 6).alias("mean_entities"),
        F.max(F.size("entities")).alias("most_entities"),
        F.round(F.avg(F.nullif("used_sentences", F.lit(0))), 6).alias("mean_sentences"),
        F.sum(hits(False)).alias("gold_hits"),
        F.sum(hits(True)).alias("deep_gold_hits"),
    )


def valid_entities(extraction: Column) -> Column:
    """Non-blank strings of a JSON array of strings; anything else goes."""
    return F.filter(F.from_json(extraction, "array<string>"), lambda x: x.isNotNull() & (F.trim(x) != ""))


def valid_triples(extraction: Column) -> Column:
    """Triples of three non-blank strings from a JSON array of arrays; anything else goes, and nothing is evaluated."""
    rows = F.from_json(extraction, "array<array<string>>")
    return F.filter(rows, lambda t: (F.size(t) == 3) & F.forall(t, lambda x: x.isNotNull() & (F.trim(x) != "")))
