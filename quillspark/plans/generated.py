"""Queries on text functions, id joins and interval files, whose inputs are made from whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import intervals, text
from quillspark.operators import matching


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _completions(spark, d):
    """(id, t): every turn of the conversations as a completion, in five forms by turn; each sentence of the turn is also asked in a line of its own."""
    body = F.expr("concat(coalesce(text, ''), '\n1. ', replace(coalesce(text, ''), '. ', '?\n- '), '?\n* Here is it?\n- Why?')")
    n = F.col("turn") % 5
    t = (
        F.when(n == 0, F.concat(F.lit("<|channel|>analysis<|message|>hm?<|end|><|start|>assistant<|channel|>final<|message|>"), body, F.lit("<|return|>")))
        .when(n == 1, F.concat(F.lit("final<|message|>"), body))
        .when(n == 2, F.concat(F.lit("analysisthinking?assistantfinal"), body))
        .when(n == 3, F.concat(F.lit("analysis only "), body))
        .otherwise(body)
    )
    return _table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), t.alias("t"))


_COMPLETIONS = """
    b AS (SELECT conv_id * 1000 + turn AS id, turn % 5 AS n, coalesce(text, '') || chr(10) || '1. ' || replace(coalesce(text, ''), '. ', '?' || chr(10) || '- ')
              || '?' || chr(10) || '* Here is it?' || chr(10) || '- Why?' AS body FROM conversations),
    c AS (SELECT id, CASE n WHEN 0 THEN '<|channel|>analysis<|message|>hm?<|end|><|start|>assistant<|channel|>final<|message|>' || body || '<|return|>'
              WHEN 1 THEN 'final<|message|>' || body WHEN 2 THEN 'analysisthinking?assistantfinal' || body WHEN 3 THEN 'analysis only ' || body ELSE body END AS t FROM b)"""
_FINAL = r"""CASE WHEN regexp_matches(t, '(?s)<\|channel\|>final<\|message\|>(.*?)(<\|return\|>|<\|end\|>|$)') THEN regexp_extract(t, '(?s)<\|channel\|>final<\|message\|>(.*?)(<\|return\|>|<\|end\|>|$)', 1)
    WHEN contains(t, 'final<|message|>') THEN substr(t, strpos(t, 'final<|message|>') + 16) WHEN contains(t, 'assistantfinal') THEN list_last(string_split(t, 'assistantfinal'))
    WHEN regexp_matches(t, '^\s*analysis\b') THEN '' ELSE regexp_replace(t, '<\|[^|]*\|>', '', 'g') END"""


def harmony_final(spark, d):
    return _completions(spark, d).select("id", F.md5(text.final_answer(F.col("t"))).alias("final_md5"))


def parsed_subquestions(spark, d):
    return _completions(spark, d).select("id", F.array_join(text.parsed_questions(F.col("t")), "|").alias("questions"))


def resolve_placeholders(spark, d):
    """Turns with placeholders, some out of range, and two answers of which one holds a placeholder itself."""
    q = F.concat(F.lit("Who is #1 of #2, #0 or #12? "), F.coalesce("text", F.lit("")), F.lit(" #"), (F.col("turn") % 10).cast("string"))
    answers = F.array(F.coalesce("role", F.lit("")), F.concat(F.lit("#1 "), F.coalesce("text", F.lit(""))))
    return _table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.resolved(q, answers)).alias("resolved_md5"))


def match_qid(spark, d):
    """Ids of documents in three forms against those of the labelled documents."""
    docs, of = _table(spark, d, "documents"), F.col("doc_id") % 3
    tid = F.concat(F.when(of == 0, "").when(of == 1, "set_").otherwise("other_set_"), F.lit("doc-"), F.col("doc_id").cast("string"))
    ours = _table(spark, d, "labels").filter("doc_id IS NOT NULL").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("qid")).distinct()
    return matching.matched_ids(docs.select(tid.alias("tid")), ours)


def chunk_ids(spark, d):
    """Every document as a chunk, with its id before a colon, with zeros, with a letter, or without a colon."""
    i, of = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    t = F.when(of == 0, F.concat(i, F.lit(": "), F.coalesce("text", F.lit("")))).when(of == 1, F.concat(F.lit("00"), i, F.lit(":x"))).when(of == 2, F.concat(F.lit("a"), i, F.lit(":x"))).otherwise(i)
    return _table(spark, d, "documents").select("doc_id", text.chunk_id(t).alias("id"))


def bridge_questions(spark, d):
    """Lines of an order as evidences: supplier (of five), ship date's month, part (of five)."""
    e = F.array(F.concat(F.lit("N"), (F.col("l_suppkey") % 5).cast("string")), F.concat(F.lit("month "), F.month("l_shipdate").cast("string")), F.concat(F.lit("N"), (F.col("l_partkey") % 5).cast("string")))
    rows = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", e.alias("e")))), lambda x: x["e"]).alias("evidences"))
    return matching.bridge_hops(rows)


def range_sort(spark, d):
    """Where the part of an order's middle line ends up after as many sorts of ranges as the order has lines."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("x"))  # an order's lines
    n = F.size("x")
    low = lambda o: (o["l_partkey"] % n + 1).cast("int")
    ops = F.transform("x", lambda o: F.struct((o["l_linenumber"] % 2).cast("int").alias("c"), low(o).alias("l"), (low(o) + o["l_suppkey"] % (n - low(o) + 1)).cast("int").alias("r")))
    v = F.transform("x", lambda o: o["l_partkey"])
    return rows.select("l_orderkey", intervals.place_after(v, ops, F.element_at(v, ((n + 1) / 2).cast("int"))).alias("place"))


def interval_constraints(spark, d):
    """Every order as a file of one case, its lines as intervals, read by the strict reader."""
    part = F.concat((F.col("l_partkey") - 20).cast("string"), F.lit(" "), (F.col("l_suppkey") * 40_000_000).cast("string"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", part.alias("t")))), lambda x: x["t"]), "\n")  # an order's lines
    files = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.concat(F.lit("1\n"), F.count("*").cast("string"), F.lit("\n"), lines, F.lit("\n")).cast("binary").alias("content"))
    return intervals.validated(files).select(F.col("path").cast("long").alias("l_orderkey"), "status", "sum_n", "n_bytes")


QUERIES = {f.__name__: f for f in (harmony_final, parsed_subquestions, resolve_placeholders, match_qid, chunk_ids, bridge_questions, range_sort, interval_constraints)}
_SIGNS = "list_transform(v, lambda z: CASE WHEN z < x THEN -1 WHEN z > x THEN 1 ELSE 0 END)"

ORACLE_SQL = {
    "harmony_final": f"WITH {_COMPLETIONS} SELECT id, md5({_FINAL}) AS final_md5 FROM c",
    "parsed_subquestions": rf"""WITH {_COMPLETIONS}, f AS (SELECT id, {_FINAL} AS f FROM c),
        l AS (SELECT id, p, trim(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^\s*([-*•]|[0-9]+[.)])\s*', '')) AS x FROM (SELECT id,
            unnest(string_split(f, chr(10))) AS x, generate_subscripts(string_split(f, chr(10)), 1) AS p FROM f) AS y),
        k AS (SELECT id, x, min(p) AS p FROM l WHERE length(x) BETWEEN 8 AND 200 AND ends_with(x, '?') AND NOT regexp_matches(lower(x),
            '^(here|sure|sub-question|output)') AND NOT contains(x, 'assistantfinal') AND NOT contains(x, '<|') GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM k)
        SELECT f.id, coalesce(string_agg(n.x, '|' ORDER BY n.p), '') AS questions FROM f LEFT JOIN n ON n.id = f.id AND n.r <= 6 GROUP BY f.id""",
    "resolve_placeholders": r"""WITH v AS (SELECT conv_id, turn, 'Who is #1 of #2, #0 or #12? ' || coalesce(text, '') || ' #' || CAST(turn % 10 AS VARCHAR) AS q, [coalesce(role, ''), '#1 ' || coalesce(text, '')] AS a FROM conversations),
        p AS (SELECT conv_id, turn, a, unnest(regexp_extract_all(q, '#[0-9]|[^#]+|#')) AS x, generate_subscripts(regexp_extract_all(q, '#[0-9]|[^#]+|#'), 1) AS i FROM v)
        SELECT conv_id, turn, md5(string_agg(CASE WHEN regexp_matches(x, '^#[1-9]$') THEN coalesce(a[CAST(substr(x, 2) AS INTEGER)], x) ELSE x END, '' ORDER BY i)) AS resolved_md5 FROM p GROUP BY conv_id, turn""",
    "match_qid": """SELECT CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'set_' ELSE 'other_set_' END || 'doc-' || CAST(doc_id AS VARCHAR) AS tid,
        CASE WHEN doc_id % 3 < 2 AND doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) THEN 'doc-' || CAST(doc_id AS VARCHAR) END AS qid FROM documents""",
    "chunk_ids": "SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN doc_id END AS id FROM documents",
    "bridge_questions": """WITH v AS (SELECT l_orderkey AS qid, list(['N' || CAST(l_suppkey % 5 AS VARCHAR), 'month ' || CAST(month(l_shipdate) AS VARCHAR), 'N' || CAST(l_partkey % 5 AS VARCHAR)] ORDER BY l_linenumber, l_partkey, l_suppkey) AS e FROM lineitem GROUP BY 1),
        s AS (SELECT qid, e, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
        m AS (SELECT qid, i, x, list_min(list_filter(range(1, i), lambda j: e[j][3] = x[1])) AS b FROM s)
        SELECT qid, CAST(i AS INTEGER) AS hop, 'What is the ' || x[2] || ' of ' || coalesce('#' || CAST(b AS VARCHAR), x[1]) || '?' AS question, x[3] AS answer FROM m""",
    "range_sort": f"""WITH g AS (SELECT l_orderkey, list({{'i': l_linenumber, 'p': l_partkey, 's': l_suppkey}} ORDER BY l_linenumber, l_partkey, l_suppkey) AS y FROM lineitem GROUP BY 1),
        k AS (SELECT l_orderkey, len(y) AS n, list_transform(y, lambda o: o.p) AS v, y[(len(y) + 1) // 2].p AS x, list_transform(y, lambda o:
            {{'c': o.i % 2, 'l': o.p % len(y) + 1, 'r': o.p % len(y) + 1 + o.s % (len(y) - o.p % len(y))}}) AS ops FROM g),
        c AS (SELECT l_orderkey, ops, {_SIGNS} AS a FROM k),
        z AS (SELECT l_orderkey, list_reduce(list_concat([{{'a': a, 'c': 0::BIGINT, 'l': 0::BIGINT, 'r': 0::BIGINT}}], list_transform(ops, lambda o:
            {{'a': []::INTEGER[], 'c': o.c::BIGINT, 'l': o.l::BIGINT, 'r': o.r::BIGINT}})),
              lambda u, o:
                  {{'a': list_concat(u.a[1:o.l - 1], CASE WHEN o.c = 1 THEN list_sort(u.a[o.l:o.r]) ELSE list_reverse_sort(u.a[o.l:o.r]) END, u.a[o.r + 1:]), 'c': 0::BIGINT, 'l': 0::BIGINT, 'r': 0::BIGINT}}).a
                  AS a FROM c)
        SELECT l_orderkey, CAST(list_position(a, 0) AS BIGINT) AS place FROM z""",
    "interval_constraints": """SELECT l_orderkey, CASE WHEN bool_and(l_partkey - 20 >= 1 AND l_suppkey * 40000000 <= 1000000000 AND l_partkey - 20 <= l_suppkey * 40000000) THEN 'OK' ELSE 'INVALID' END AS status,
            CASE WHEN bool_and(l_partkey - 20 >= 1 AND l_suppkey * 40000000 <= 1000000000 AND l_partkey - 20 <= l_suppkey * 40000000) THEN count(*) END AS sum_n,
            CAST(3 + length(CAST(count(*) AS VARCHAR)) + sum(length(CAST(l_partkey - 20 AS VARCHAR)) + length(CAST(l_suppkey * 40000000 AS VARCHAR)) + 2) AS BIGINT) AS n_bytes
        FROM lineitem GROUP BY 1""",
}
