"""Queries by name, each with the SQL that DuckDB runs on the same tables where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LINES = """lines AS (SELECT doc_id, lang, source, unnest(range(len(string_split(text, chr(10))))) AS line_no,
  unnest(string_split(text, chr(10))) AS line FROM documents)"""
TELE = """tele AS (SELECT event_id AS id, ts AS timestamp, user_id AS session_id, 'm' || CAST(user_id % 3 AS VARCHAR) AS model,
  CASE event_type WHEN 'view' THEN 'suggested' WHEN 'purchase' THEN 'accepted' WHEN 'click' THEN 'partially_accepted' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'ignored' END AS event_type,
  event_id // 3 AS suggestion_id, value AS latency_ms, value / (value + 50) AS confidence, CAST(json_extract_string(props, '$.k') AS INTEGER) AS prompt_length FROM events)"""


def query(name: str, sql: str | None = None):
    """Registers a query function; ``sql`` may name the CTEs above by ``WITH LINES`` and ``WITH TELE``."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.replace("WITH LINES", f"WITH {LINES}").replace("WITH RECURSIVE LINES", f"WITH RECURSIVE {LINES}").replace("WITH TELE", f"WITH {TELE}")
        return f

    return add
