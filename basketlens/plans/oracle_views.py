"""DuckDB text of the fixture views, for the ``oracle_sql()`` contract.

The oracle SQL of each query is ``WITH <views it needs> <query>``; views are
emitted in dependency order.
"""

from __future__ import annotations

VIEWS: dict[str, tuple] = {
    "as_of_t": ((), "SELECT max(ts) AS as_of FROM events"),
    "rec_as_of_t": ((), "SELECT max(l_shipdate) AS as_of FROM lineitem"),
    "raw_behaviors": ((), """
        SELECT e.event_id, e.user_id, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS item_id,
               p.p_type AS category_id,
               CASE e.event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click'
                    WHEN 'signup' THEN 'add_to_cart' WHEN 'purchase' THEN 'purchase' ELSE 'error' END AS action,
               e.ts, e.value AS dwell_time,
               CASE WHEN e.event_type = 'purchase' THEN e.value ELSE 0.0 END AS price
        FROM events e LEFT JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)"""),
    "behaviors": (("raw_behaviors",), """
        SELECT * EXCLUDE (prev_ts, s), CAST(s AS BIGINT) AS session_seq,
               CAST(user_id AS VARCHAR) || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) AS session_id
        FROM (SELECT *, sum(CASE WHEN prev_ts IS NOT NULL AND ts - prev_ts <= INTERVAL 6 HOUR THEN 0 ELSE 1 END)
                        OVER (PARTITION BY user_id ORDER BY ts, event_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
              FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts
                    FROM raw_behaviors WHERE action <> 'error'))"""),
    "users": (("as_of_t",), """
        SELECT c_custkey AS user_id, c_name AS user_name, c_mktsegment AS user_segment,
               (SELECT as_of FROM as_of_t) - to_days(CAST(c_custkey % 60 AS INTEGER)) AS first_visit
        FROM customer"""),
    "items": (("as_of_t",), """
        SELECT p_partkey AS item_id, p_name AS item_name, p_type AS category_id, p_brand AS brand,
               p_size AS size, p_retailprice AS price,
               (SELECT as_of FROM as_of_t) - to_days(CAST(p_partkey % 45 AS INTEGER)) AS launch_date
        FROM part"""),
    "rec_log": ((), """
        SELECT l_orderkey AS request_id, l_partkey AS item_id, l_shipdate AS ts,
               CAST(l_returnflag = 'A' AS INTEGER) AS clicked
        FROM lineitem"""),
    "ledger": ((), """
        SELECT l_partkey AS sku,
               row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
                   l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
               CASE l_returnflag WHEN 'A' THEN 'DEDUCT' WHEN 'N' THEN 'RESERVE' WHEN 'R' THEN 'ROLLBACK'
                    ELSE 'ADD' END AS op,
               CAST(l_quantity AS INTEGER) AS qty, l_shipdate AS ts, l_orderkey AS order_id,
               CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT) AS unit_price_cents
        FROM lineitem"""),
    "opening_stock": ((), "SELECT p_partkey AS sku, CAST(100 + 5 * p_size AS BIGINT) AS opening FROM part"),
}


def with_views(sql: str, *names: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """Prefix ``sql`` with the CTEs ``names`` (and their dependencies)."""
    views = dict(VIEWS)
    views.update(extra or {})
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in views[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({views[n][1].strip()})" for n in order)
    recursive = any(len(views[n]) > 2 and views[n][2] for n in order)
    head = "WITH RECURSIVE" if recursive else "WITH"
    body = sql.strip()
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        if rest[:9].upper() == "RECURSIVE":
            head, rest = "WITH RECURSIVE", rest[9:].lstrip()
        return f"{head} {ctes},\n{rest}"
    return f"{head} {ctes}\n{body}"
