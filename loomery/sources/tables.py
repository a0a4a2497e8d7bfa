"""Engine tables derived from the driver's tables.

Each definition is one SELECT that Spark and DuckDB both read, so a query and its twin start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Name: (tables it reads, SELECT).  {name} stands for a table.
DERIVED: dict[str, str] = {
    "chunks": """SELECT doc_id AS id, doc_id % 50 AS file_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE split_part(text, ' ', 1) END AS symbol_name,
        CASE doc_id % 6 WHEN 0 THEN 'func' WHEN 1 THEN 'class' WHEN 2 THEN 'method' WHEN 3 THEN 'heading_1' WHEN 4 THEN 'test_func' ELSE 'variable' END AS kind,
        CAST(floor(doc_id / 50) AS BIGINT) * 10 + 1 AS start_line, CAST(floor(doc_id / 50) AS BIGINT) * 10 + 9 AS end_line,
        CAST(doc_id % 11 AS DOUBLE) / 10 AS recency_score, CAST(doc_id % 5 AS DOUBLE) AS churn_score, lang AS language, source, substring(text, 1, 200) AS preview,
        concat(CASE WHEN doc_id % 9 = 0 THEN 'tests/' ELSE 'src/' END, source, '/f', CAST(doc_id % 50 AS STRING), CASE WHEN doc_id % 8 = 0 THEN '_test.rs' ELSE '.rs' END) AS relpath,
        sha256(text) AS blob_sha FROM {documents}""",
    "edges": """SELECT doc_id AS src, (doc_id * 7 + 3) % n AS dst, CASE doc_id % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'test_of' ELSE 'calls' END AS type
        FROM {documents} CROSS JOIN (SELECT count(*) AS n FROM {documents}) t
        UNION ALL SELECT doc_id AS src, (doc_id * 3 + 1) % n AS dst, CASE WHEN doc_id % 3 = 0 THEN 'imports' ELSE 'calls' END AS type
        FROM {documents} CROSS JOIN (SELECT count(*) AS n FROM {documents}) t
        UNION ALL SELECT doc_id AS src, CAST(floor(doc_id / 10) AS BIGINT) AS dst, 'extends' AS type FROM {documents}""",
    "junction": """SELECT doc_id AS chunk_id, doc_id % 3 AS worktree_id FROM {documents} UNION ALL SELECT doc_id AS chunk_id, 3 AS worktree_id FROM {documents} WHERE doc_id % 5 = 0""",
    "cells": """SELECT CAST(user_id AS STRING) AS soul, concat(event_type, CAST(event_id % 3 AS STRING)) AS key,
        CASE event_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'null' WHEN 2 THEN 'link' ELSE 'num' END AS vtype,
        CASE WHEN event_id % 5 = 0 THEN concat('v', CAST(event_id % 13 AS STRING)) END AS v_text,
        CASE WHEN event_id % 5 > 2 THEN CAST(event_id % 1000 AS DOUBLE) END AS v_num, CAST(NULL AS BOOLEAN) AS v_bool,
        CASE WHEN event_id % 5 = 2 THEN CAST(event_id % 50 AS STRING) END AS v_link, CAST(event_id % 997 AS DOUBLE) AS state, CAST(event_id AS STRING) AS msg_id, event_id FROM {events}""",
    "ranked": """SELECT user_id AS query_id, event_id AS id, rank, value AS score, event_type = 'click' OR event_type = 'purchase' AS relevant,
        CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS grade
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM {events}) t""",
    "old_files": """SELECT concat('f', CAST(o_orderkey AS STRING)) AS path, concat('h', CAST(o_custkey AS STRING)) AS hash FROM {orders} WHERE o_orderkey % 5 <> 0""",
    "new_files": """SELECT concat('f', CAST(o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 10000000 ELSE 0 END AS STRING)) AS path,
        concat('h', CAST(o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS STRING)) AS hash FROM {orders} WHERE o_orderkey % 3 <> 0""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or derived table."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = DERIVED[name].replace("sha256(text)", "sha2(text, 256)")
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in sorted(set(re.findall(r"\{(\w+)\}", sql)))})


def twin(sql: str, *names: str) -> str:
    """DuckDB SQL with the derived tables put before it."""
    parts = [f"{n} AS ({re.sub(r'[{}]', '', DERIVED[n]).replace('AS STRING', 'AS VARCHAR')})" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {', '.join(parts)}, {body[4:].strip()}"
    return f"WITH {', '.join(parts)} {body}" if parts else body
