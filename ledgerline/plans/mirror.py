"""Deterministic drifted copies of the test tables, the same in Spark SQL and DuckDB."""

ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 101 = 7 THEN o_totalprice + 1.0 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 97 <> 5
UNION ALL
SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 103 = 11"""

EVENTS = """
SELECT event_id, ts, user_id, CASE WHEN event_id % 50 = 3 THEN concat(event_type, '!') ELSE event_type END AS event_type, value, props
FROM events WHERE event_id % 60 <> 7"""

CONVERSATIONS = """
SELECT conv_id, turn, role, CASE WHEN (conv_id * 7 + turn) % 41 = 5 THEN concat(text, ' ') ELSE text END AS text FROM conversations WHERE (conv_id + turn) % 37 <> 2
UNION ALL
SELECT conv_id + 1000000, turn, role, text FROM conversations WHERE conv_id % 53 = 4"""

#: A later state of the copy: a third of the drift has gone.
ORDERS_LATER = ORDERS.replace("o_orderkey % 101 = 7 THEN", "o_orderkey % 101 = 7 AND o_orderkey % 3 <> 0 THEN").replace("o_orderkey % 97 <> 5", "(o_orderkey % 97 <> 5 OR o_orderkey % 3 = 1)")
