"""Where plans register their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: DuckDB views of the fixtures: see ``vicinity.sources.fixtures``.
FEAT = "feat AS (SELECT vec_id AS idx, label AS pid, CAST(vec_id % 6 AS INT) AS cam, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
IDS = (
    FEAT + ", ids AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY cam ORDER BY pid) - 1 AS INT) AS intra_id, CAST(dense_rank() OVER (ORDER BY cam, pid) - 1 AS INT) AS accum_id,"
    " CAST(row_number() OVER (PARTITION BY cam ORDER BY idx) - 1 AS INT) AS img_idx FROM feat)"
)
NAMES = FEAT + ", names AS (SELECT idx, lpad(CAST(pid AS VARCHAR), 4, '0') || '_c' || (cam + 1) || 's1_' || lpad(CAST(idx AS VARCHAR), 6, '0') || '_01.jpg' AS name FROM feat)"


def query(name: str, oracle: str | None = None):
    """Registers a (spark, sf_dir) function; ``oracle`` is DuckDB SQL for the same rows."""

    def register(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register
