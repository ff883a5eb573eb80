"""The canonical views as DuckDB SQL, for the oracles."""

MESSAGES = """messages AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS ordinal, role, text AS content,
         CAST(coalesce(length(text) // 4, 0) AS BIGINT) AS token_count,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn) AS created_at, conv_id
  FROM conversations
)"""

SESSIONS = (
    MESSAGES
    + """, sessions AS (
  SELECT session_id, CAST(conv_id % 10 AS VARCHAR) AS user_id, 'New Chat' AS title, created_at, updated_at, conv_id,
         CASE WHEN conv_id % 3 <> 0 THEN created_at + INTERVAL 2 MINUTE END AS summary_updated_at,
         CASE WHEN conv_id % 3 <> 0 THEN 'Summary of ' || session_id END AS current_summary
  FROM (SELECT session_id, conv_id, min(created_at) AS created_at, max(created_at) AS updated_at FROM messages GROUP BY ALL)
)"""
)

WINDOWED = (
    SESSIONS
    + """, windowed AS (
  SELECT *, CASE WHEN tokens_from_here <= 450 THEN 'keep' ELSE 'compress' END AS bucket FROM (
    SELECT *, CAST(sum(token_count) OVER (PARTITION BY session_id ORDER BY created_at DESC, ordinal DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens_from_here,
           sum(token_count) OVER (PARTITION BY session_id) >= 720 AS needs_compression
    FROM messages)
)"""
)

ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


def iso(column: str) -> str:
    return ISO.format(column)
