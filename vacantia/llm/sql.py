"""DuckDB SQL for the queries of this subpackage that SQL can state over whole tables."""

from __future__ import annotations

_EXACT = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g USING (text)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": _EXACT}
