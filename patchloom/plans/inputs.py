"""Inputs of the registered queries: advisories, commits, functions and labels derived from the given tables.

Each is a SELECT that Spark and other engines read alike, with table names in braces. Sparse values come from nulls made
by CASE, and hashes stand for commits, so every input grows with its table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SHA = "sha1(CAST(o_orderkey AS STRING))"
_BASE = f"'https://github.com/o' || CAST(o_custkey % 50 AS STRING) || '/p' || CAST(o_orderkey % 7 AS STRING) || '/commit/' || {SHA}"

SELECTS = {
    # A reference to a commit, decorated in ten ways.
    "refs": f"""
SELECT o_orderkey AS id, o_custkey AS owner_id, {SHA} AS sha, CASE o_orderkey % 10
  WHEN 0 THEN {_BASE} || '.patch' WHEN 1 THEN {_BASE} || '#comments' WHEN 2 THEN {_BASE} || '?w=1'
  WHEN 3 THEN {_BASE} || 'CONFIRM:' WHEN 4 THEN 'https://github.com/o1/p/commits/master' WHEN 5 THEN {_BASE} || '%23diff'
  WHEN 6 THEN {_BASE} || '/' WHEN 7 THEN 'https://bitbucket.org/o/p/commits/' || {SHA} WHEN 8 THEN 'https://gitlab.com/o/p/commit/' || {SHA}
  ELSE 'https://example.com/advisory/' || CAST(o_orderkey AS STRING) END AS url
FROM {{orders}}""",
    # Functions of files: every line item is one, of an order's file.
    "functions": """
SELECT 'o' || CAST(l_suppkey % 3 AS STRING) AS owner, 'p' AS project, 'v1' AS version, 'f' || CAST(l_orderkey AS STRING) || '.js' AS fpath,
       CAST((l_linenumber - 1) * 10 + 1 AS INT) AS sline, 0 AS scol, CAST((l_linenumber - 1) * 10 + 5 + l_partkey % 12 AS INT) AS eline, 1 AS ecol,
       CASE WHEN l_partkey % 3 = 0 THEN 'fn_exp' ELSE 'fn_dec' END AS ftype, l_linenumber AS ord
FROM {lineitem}""",
    "regions": """
SELECT 'o' || CAST(l_suppkey % 3 AS STRING) AS owner, 'p' AS project, 'v1' AS version, 'f' || CAST(l_orderkey AS STRING) || '.js' AS fpath,
       CAST((l_linenumber - 1) * 10 + 2 AS INT) AS sline, 3 AS scol, CAST((l_linenumber - 1) * 10 + 4 AS INT) AS eline, 0 AS ecol,
       CASE WHEN l_returnflag = 'R' THEN 'CWE-79' ELSE 'safe' END AS label, md5(CAST(l_orderkey AS STRING)) AS pair_hash
FROM {lineitem}""",
    # Labels of two analyses by hash.
    "diff_labels": """
SELECT md5(CAST(doc_id AS STRING)) AS hash, CASE WHEN quality = 1 THEN 'safe' ELSE 'unsafe' END AS label,
       CASE WHEN quality = 0 THEN 'CWE-' || CAST(doc_id % 5 AS STRING) END AS cwe, CASE WHEN quality = 0 AND doc_id % 3 > 0 THEN 's' || CAST(doc_id % 3 AS STRING) END AS sfp
FROM {labels}""",
    "static_labels": """
SELECT md5(CAST(doc_id AS STRING)) AS hash, CASE WHEN doc_id % 4 = 0 THEN 'unsafe' ELSE 'safe' END AS label,
       CASE WHEN doc_id % 4 = 0 THEN 'CWE-' || CAST(doc_id % 3 AS STRING) END AS cwe, CASE WHEN doc_id % 4 = 0 AND doc_id % 5 > 0 THEN 's' || CAST(doc_id % 5 AS STRING) END AS sfp
FROM {documents}""",
    # Rows with label, text, pair and tag for splits.
    "samples": """
SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN 'safe' ELSE 'unsafe' END AS label, d.text AS text, md5(CAST(l.doc_id % 97 AS STRING)) AS pair_hash,
       d.source AS project, CASE WHEN l.doc_id % 3 = 0 THEN 'vuln' WHEN l.doc_id % 3 = 1 THEN 'fix' ELSE 'non-vuln' END AS tag
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    # Fix rows with class, commit, project and type.
    "attributes": """
SELECT event_id AS id, CASE WHEN value > 50 THEN 'unsafe' ELSE 'safe' END AS label, md5(CAST(user_id AS STRING)) AS vuln_commit_hash, event_type AS bf_class,
       CASE WHEN event_id % 11 > 0 THEN CAST(event_id % 4 AS INT) END AS cwe_id, 'p' || CAST(user_id % 5 AS STRING) AS project,
       CASE event_id % 3 WHEN 0 THEN 'utility' WHEN 1 THEN 'server' ELSE 'unk' END AS sw_type
FROM {events}""",
    # Cleaned commits with nulls in what filters look at.
    "commits": f"""
SELECT o_orderkey AS id, {SHA} AS commit_sha, 'https://github.com/o' || CAST(o_custkey % 50 AS STRING) || '/p' || CAST(o_orderkey % 7 AS STRING) || '/commit/x' AS commit_href,
       CASE WHEN o_orderkey % 9 > 0 THEN 'CWE-' || CAST(o_orderkey % 130 AS STRING) END AS cwe, CASE WHEN o_orderkey % 8 > 0 THEN {SHA} END AS last_fix_commit,
       CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Merge message of branch' ELSE 'Fix ' || o_orderpriority END AS message,
       CASE o_orderkey % 6 WHEN 0 THEN NULL ELSE md5(CAST(o_orderkey AS STRING)) END AS parent,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'renamed' WHEN 2 THEN 'removed' ELSE 'modified' END AS status,
       CASE o_orderkey % 6 WHEN 0 THEN 'src/a.js' WHEN 1 THEN 'src/tests/a.js' WHEN 2 THEN 'lib/MyTest.js' WHEN 3 THEN 'src/b.PY' WHEN 4 THEN 'Makefile' ELSE 'src/c.tar.gz' END AS file_path,
       o_orderdate AS author_date, o_custkey AS chain_id, CAST(o_orderkey % 1000 AS BIGINT) AS a_file_size, CAST(o_custkey % 800 AS BIGINT) AS b_file_size
FROM {{orders}}""",
    # Three-part contexts of documents' words.
    "words": "SELECT doc_id AS id, lang AS label, text FROM {documents}",
}
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings", "nation", "region")


def given(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """Result of one of SELECTS, or of another SELECT with table names in braces, on the tables of a folder."""
    text = SELECTS.get(select, select)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **frames)


def as_sql(select: str) -> str:
    """One of SELECTS with plain table names."""
    return re.sub(r"\{(\w+)\}", r"\1", SELECTS.get(select, select)).strip()
