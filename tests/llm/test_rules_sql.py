"""The columns of the quality rules that SQL can express, on a whole table."""

import duckdb

from quillspark.llm import rules

SF = "/root/testdata/sf0.01"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM '{SF}/documents.parquet'),
line AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) AS l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d) AS x),
again AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN again USING (doc_id, s)) AS x GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
       CAST(coalesce(line.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(word.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(word.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN line USING (doc_id) LEFT JOIN word USING (doc_id) ORDER BY d.doc_id"""


def test_base_columns_equal_sql(spark):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = rules.op6_rules(spark, SF).select(*columns, "kept").orderBy("doc_id").collect()
    assert [tuple(r)[:-1] for r in got] == duckdb.sql(SQL).fetchall()
    assert not any(r.kept for r in got if r.base_failed) and any(r.kept for r in got)
