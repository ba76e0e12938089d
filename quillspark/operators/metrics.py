"""Recall and its breakdowns, paired deltas and bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import bucket_label

KS = (2, 5, 10)
#: Values that a bootstrap draws at a time, at least one resample.
DRAWN = 1 << 20


def recall(gold: Column, ranked: Column, k) -> Column:
    """Null without gold."""
    return F.size(F.array_intersect(gold, F.slice(ranked, 1, k))) / F.nullif(F.size(gold), F.lit(0))


def option_recall(options: Column, ranked: Column, k) -> Column:
    """The share of gold passages with at least one of their alternatives among the first k."""
    top = F.slice(ranked, 1, k)
    return F.size(F.filter(options, lambda o: F.arrays_overlap(o, top))) / F.nullif(F.size(options), F.lit(0))


def as_lists(ranking: DataFrame) -> DataFrame:
    """(qid, ranked): the pids of a query, best first; as long as the ranking is deep."""
    return ranking.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "pid"))), lambda x: x["pid"]).alias("ranked"))


def per_query(queries: DataFrame, ranking: DataFrame, ks=KS) -> DataFrame:
    """A row for each query and k with its recall.  queries: qid, gold and any columns to break down by."""
    lists = as_lists(ranking)
    ranked = queries.join(lists, "qid", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<bigint>")))
    return ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("recall", recall(F.col("gold"), F.col("ranked"), F.col("k"))).drop("ranked")


def per_query_hits(queries: DataFrame, hits: DataFrame, ks=KS, by: tuple[str, ...] = ()) -> DataFrame:
    """As ``per_query`` from counts: queries (qid, n_gold, ...) and ranks (qid, rank) of the gold passages that a ranking found, for each of ``by`` apart; no list of gold is made."""
    found = hits.groupBy(*by, "qid").agg(*(F.count_if(F.col("rank") < k).alias(f"_h{k}") for k in ks))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"_h{k}", F.lit(0)).alias("h")) for k in ks)))
    joined = queries.join(found, [*by, "qid"], "left").withColumn("_x", each)
    return joined.withColumn("k", F.col("_x.k")).withColumn("recall", F.col("_x.h") / F.nullif(F.col("n_gold"), F.lit(0))).drop("_x", *(f"_h{k}" for k in ks))


def _by_sets(rows: DataFrame, fixed: list[str], by: list[str], *measures: Column) -> DataFrame:
    """Measures over all rows and by each of ``by`` in one pass of grouping sets; section and bucket say which."""
    cells = rows.groupingSets([[*fixed], *([*fixed, b] for b in by)], *fixed, *by) if by else rows.groupBy(*fixed)
    section, bucket = F.lit("overall"), F.lit("")
    for b in by:
        section = F.when(F.grouping(b) == 0, b).otherwise(section)
        bucket = F.when(F.grouping(b) == 0, F.col(b).cast("string")).otherwise(bucket)
    made = cells.agg(section.alias("section"), bucket.alias("bucket"), *measures)
    return made.drop(*by)


def report(recalls: DataFrame, *by: str) -> DataFrame:
    """Means overall and by each of ``by`` in one pass of grouping sets; buckets without a defined recall are left out,
    while the overall rows stay.  n counts defined recalls, n_all all queries."""
    made = _by_sets(recalls, ["k"], list(by), F.round(F.avg("recall"), 6).alias("mean"), F.count("recall").alias("n"), F.count("*").alias("n_all"))
    return made.filter("n > 0 OR section = 'overall'").select("section", "bucket", "k", "mean", "n", "n_all")


def checked_overall(made: DataFrame) -> DataFrame:
    """The report, or an error when no query at all has gold."""
    if not made.filter("section = 'overall' AND n > 0").limit(1).count():
        raise ValueError("no query has gold passages")
    return made


def bootstrap_interval(values, n: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of the mean of values in their order; NaN for fewer than two.  Draws, alpha and seed are fixed values that the result's bits depend on."""
    x = np.asarray([v for v in values if v is not None and v == v], float)
    if len(x) < 2:
        return float("nan"), float("nan")
    rng, at_once = np.random.default_rng(seed), max(1, DRAWN // len(x))  # the generator gives the same draws in pieces
    means = [x[rng.integers(0, len(x), size=(min(at_once, n - i), len(x)))].mean(axis=1) for i in range(0, n, at_once)]
    low, high = np.quantile(np.concatenate(means), [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


def intervals(values: DataFrame, *group: str) -> DataFrame:
    """lo and hi for each group of (ord, value); a group is the evaluated queries of one bucket, ordered by ``ord``."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_interval(pdf.sort_values("ord")["value"])
        return pd.DataFrame([[*key, low, high]], columns=[*group, "lo", "hi"])

    types = dict(values.dtypes)
    schema = ", ".join([*(f"{g} {types[g]}" for g in group), "lo double", "hi double"])
    return values.select(*group, "ord", "value").groupBy(*group).applyInPandas(run, schema)


def paired(recalls: DataFrame, baseline: str) -> DataFrame:
    """Differences to the baseline arm on the same query and k, where both are defined."""
    base = recalls.filter(F.col("arm") == baseline).select("qid", "k", F.col("recall").alias("base"))
    return recalls.filter(F.col("arm") != baseline).join(base, ["qid", "k"]).withColumn("delta", F.col("recall") - F.col("base")).filter("delta IS NOT NULL").drop("base")


def delta_table(recalls: DataFrame, baseline: str, *by: str) -> DataFrame:
    """Mean differences of each arm (arm, k, section, bucket, delta, n), overall and by bucket, with the number of pairs."""
    return _by_sets(paired(recalls, baseline), ["arm", "k"], list(by), F.round(F.avg("delta"), 6).alias("delta"), F.count("*").alias("n"))


def full_delta_table(recalls: DataFrame, baseline: str, covered: DataFrame | None = None, label: Column | None = None, order: str = "qid") -> DataFrame:
    """The table that users read: (section, bucket, arm, k, delta, n, lo, hi, star) for all questions, by depth and kind
    (``label``, else n_hops and is_join), by shape, and over the questions (arm, qid) that an arm covers, with bootstrap intervals.
    Intervals draw from the questions in the order of ``order``, their position; a cell of one question has no interval and no star."""
    rows = paired(recalls, baseline)
    label = label if label is not None else bucket_label(F.col("n_hops"), F.col("is_join"))
    kind = F.coalesce(F.nullif(F.col("shape").cast("string"), F.lit("")), F.lit("?"))
    named = (("all", F.lit("all")), ("depth x shape", label), ("question type", kind))
    sections = F.array(*(F.struct(F.lit(s).alias("section"), b.cast("string").alias("bucket")) for s, b in named))
    rows = rows.withColumn("_ord", F.col(order))
    each = rows.select("arm", "k", "_ord", "delta", F.explode(sections).alias("x")).select("arm", "k", "_ord", "delta", "x.*")
    if covered is not None:
        each = each.union(covered_only(rows, covered).select("arm", "k", "_ord", "delta", F.lit("covered").alias("section"), F.col("arm").alias("bucket")))
    group = ["section", "bucket", "arm", "k"]
    means = each.groupBy(*group).agg(F.round(F.avg("delta"), 6).alias("delta"), F.count("*").alias("n"))
    limits = intervals(each.select(*group, F.col("_ord").alias("ord"), F.col("delta").alias("value")), *group)
    outside = (F.col("lo") > 0) | (F.col("hi") < 0)
    return means.join(limits, group).withColumn("star", (F.col("n") > 1) & F.coalesce(outside, F.lit(False)))


def covered_only(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """Rows of the questions for which their arm has sub-questions; covered: arm, qid."""
    return rows.join(covered.select("arm", "qid").distinct(), ["arm", "qid"], "left_semi")


def coverage_delta(recalls: DataFrame, baseline: str, covered: DataFrame) -> DataFrame:
    """Mean difference of each arm over the questions that it covers."""
    return covered_only(paired(recalls, baseline), covered).groupBy("arm", "k").agg(F.round(F.avg("delta"), 6).alias("delta"), F.count("*").alias("n"))


def content_effect(deltas: DataFrame, control: str) -> DataFrame:
    """How much of each arm's difference is more than the control's: rows of a delta table less those of the control arm."""
    group = [c for c in deltas.columns if c not in ("arm", "delta", "n")]
    base = deltas.filter(F.col("arm") == control).select(*group, F.col("delta").alias("control"))
    return deltas.filter(F.col("arm") != control).join(base, group).select("arm", *group, F.round(F.col("delta") - F.col("control"), 6).alias("effect"))


def hop_hits(hops: DataFrame, ranking: DataFrame, ks=KS) -> DataFrame:
    """Hit rates of each hop's own gold passage.  hops: qid, hop from 1, gold_pid; hops without one are skipped."""
    found = hops.filter("gold_pid IS NOT NULL").join(ranking.select("qid", F.col("pid").alias("gold_pid"), "rank"), ["qid", "gold_pid"], "left")
    rows = found.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return rows.groupBy("hop", "k").agg(F.round(F.avg(F.coalesce((F.col("rank") < F.col("k")).cast("double"), F.lit(0.0))), 6).alias("mean"), F.count("*").alias("n"))


def rendered(rows: list, title: str = "") -> str:
    """A fixed-width table of collected report rows."""
    out = [f"{title}\n{'=' * len(title)}"] if title else []
    for r in sorted(rows, key=lambda r: (r.section, r.bucket, r.k)):
        mean = "-" if r.mean is None else f"{r.mean:.4f}"
        out.append(f"  {r.section:<10} {r.bucket:<14} recall@{r.k}={mean} (n={r.n})")
    return "\n".join(out)


def marked(delta: float | None, low: float, high: float, n: int) -> str:
    """A cell of a delta table: starred when the interval leaves out zero."""
    if not n:
        return "-"
    if n < 2:
        return f"{delta:+.4f} (n<2)"
    return f"{delta:+.4f}" + ("*" if low > 0 or high < 0 else "")


def rendered_deltas(rows: list, k: int) -> str:
    """The cells of one depth of a full delta table as text: a section after the other, a line for each bucket, a column for each arm."""
    mine = [r for r in rows if r.k == k]
    names = sorted({r.arm for r in mine})
    cells = {(r.section, r.bucket, r.arm): marked(r.delta, *((r.lo, r.hi) if r.n > 1 else (0.0, 0.0)), r.n) for r in mine}
    out = [f"{'recall@' + str(k):<30}" + "".join(f"{a:>18}" for a in names)]
    for section in ("all", "depth x shape", "question type", "covered"):
        buckets = sorted({r.bucket for r in mine if r.section == section})
        if buckets:
            out.append(section)
        out += [f"  {b:<28}" + "".join(f"{cells.get((section, b, a), '-'):>18}" for a in names) for b in buckets]
    return "\n".join(out)
