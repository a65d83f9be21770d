"""SQL twins of ``calibra.sources.views`` for the DuckDB oracle.

Written as CTE bodies; ``with_views("preds", "log")`` builds the WITH clause.
"""

from __future__ import annotations


def U(salt: str, key: str) -> str:
    return (f"((('0x' || substr(md5('{salt}:' || CAST({key} AS VARCHAR)), 1, 8))::UBIGINT)::DOUBLE"
            f" / 4294967296.0)")


_Y = "CAST(o_orderstatus = 'F' AS INTEGER)"
_A = f"floor(100.0 * (0.3 * {_Y} + 0.7 * {U('a', 'o_orderkey')})) / 100.0"
_B = f"floor(100.0 * (0.4 * {_Y} + 0.6 * {U('b', 'o_orderkey')})) / 100.0"
_C = f"floor(100.0 * {U('c', 'o_orderkey')}) / 100.0"

VIEWS = {
    "preds": f"""
    SELECT o_orderkey, {_Y} AS y_true,
           {_A} AS score_a, {_B} AS score_b, {_C} AS score_c,
           CAST({_A} >= 0.5 AS INTEGER) AS pred_a,
           CAST({_B} >= 0.5 AS INTEGER) AS pred_b,
           CAST({_C} >= 0.5 AS INTEGER) AS pred_c,
           {U('ab', 'o_orderkey')} < 0.5 AS route,
           CAST(o_orderdate AS DATE) AS day
    FROM orders""",
    "preds_long": """
    SELECT o_orderkey, y_true, day, route, 'a' AS model, score_a AS score, pred_a AS y_pred FROM preds
    UNION ALL
    SELECT o_orderkey, y_true, day, route, 'b', score_b, pred_b FROM preds
    UNION ALL
    SELECT o_orderkey, y_true, day, route, 'c', score_c, pred_c FROM preds""",
    "tx": """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice, l_discount, l_tax,
           CAST(l_returnflag = 'R' AS INTEGER) AS Class,
           CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'reference' ELSE 'current' END AS side
    FROM lineitem""",
    "log": """
    SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type,
           CAST(event_type = 'error' AS INTEGER) AS prediction,
           value AS processing_time_ms,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 AS score
    FROM events""",
    "runs": """
    SELECT event_id AS run_id, event_type AS experiment, CAST(ts AS TIMESTAMP) AS start_time,
           value AS metric_value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS metric_k, user_id
    FROM events""",
    "model_version": """
    SELECT n_name AS name, s_suppkey AS version, s_suppkey AS run_id,
           (['None', 'Staging', 'Production'])[CAST((s_suppkey % 3 + 3) % 3 AS INTEGER) + 1] AS current_stage,
           TIMESTAMP '2024-01-01 00:00:00' + CAST(s_suppkey AS INTEGER) * INTERVAL 1 HOUR AS creation_timestamp
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "imbalanced": """
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS features, CAST(label = 0 AS INTEGER) AS Class
    FROM embeddings""",
}

# dependencies between views
_DEPS = {"preds_long": ["preds"]}


def with_views(*names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in order)
