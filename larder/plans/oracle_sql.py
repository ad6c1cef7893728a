"""Independent SQL oracle (DuckDB) for the registered queries.

``PREFIX`` re-derives the restaurant tables from the driver views with the
same rules as ``larder.sources.testdata``.  Each oracle statement is
``PREFIX`` + one SELECT.  Oracle hygiene: decimals are cast before summing
and final money values are cast to DOUBLE on both sides, counts to BIGINT.
"""

from __future__ import annotations

PREFIX = """
WITH
suppliers AS (
  SELECT s_suppkey AS supplier_id, s_name AS name,
         '0171' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS phone,
         CASE WHEN s_suppkey % 4 = 3 THEN NULL
              ELSE 'supplier' || CAST(s_suppkey AS VARCHAR) || '@example.com' END AS email,
         'Nation ' || CAST(s_nationkey AS VARCHAR) AS address
  FROM supplier),
ingredients AS (
  SELECT p_partkey AS ingredient_id,
         p_name || ' #' || CAST(p_partkey AS VARCHAR) AS name,
         CASE WHEN p_size % 3 = 0 THEN 'kg' WHEN p_size % 3 = 1 THEN 'litre' ELSE 'pcs' END AS unit,
         CAST(p_size AS DECIMAL(10,2)) AS quantity,
         CAST(p_partkey % 20 + 10 AS DECIMAL(10,2)) AS reorder_level,
         CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price,
         CASE WHEN p_partkey % 6 = 0 THEN NULL
              ELSE p_partkey % ((SELECT count(*) FROM supplier) + 5) END AS supplier_id
  FROM part),
li_ids AS (
  SELECT *, l_orderkey * 1048576 + row_number() OVER (
           PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                            l_quantity, l_extendedprice, l_shipdate) AS row_id
  FROM lineitem),
purchases AS (
  SELECT l_orderkey * 1048576 + row_number() OVER (
           PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                            l_quantity, l_extendedprice, l_shipdate) AS purchase_id,
         l_suppkey AS supplier_id, l_partkey AS ingredient_id,
         CAST(l_quantity AS DECIMAL(10,2)) AS quantity,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS cost,
         CAST(l_shipdate AS DATE) AS purchase_date
  FROM lineitem WHERE l_returnflag = 'R'),
menu_items AS (
  SELECT p_partkey AS menu_id, p_name AS name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price,
         CAST((p_size % 5) * 5 AS DECIMAL(5,2)) AS discount,
         CAST(CASE WHEN p_size % 7 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS is_available
  FROM part),
recipes AS (
  SELECT menu_id, (menu_id * 7 + k) % (SELECT count(*) FROM part) AS ingredient_id,
         CAST((k + 1) * CAST(0.05 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS qty_required
  FROM (SELECT p_partkey AS menu_id, unnest(generate_series(0, p_partkey % 4)) AS k
        FROM part WHERE p_partkey % 13 <> 0)),
customers AS (
  SELECT c_custkey AS customer_id, c_name AS name,
         '0181' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone
  FROM customer),
bill_requests AS (
  -- reads the driver's orders view, so it precedes the derived orders CTE
  SELECT o_orderkey AS order_id,
         CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS customer_id
  FROM orders),
order_deletes AS (
  -- reads the driver's orders view, so it precedes the derived orders CTE
  SELECT o_orderkey AS order_id FROM orders WHERE o_orderkey % 11 = 5),
status_changes AS (
  -- reads the driver's orders view, so it precedes the derived orders CTE
  SELECT o_orderkey * 4 + 1 AS seq, o_orderkey AS order_id, 'staff' AS actor,
         CAST(NULL AS BIGINT) AS customer_id,
         CASE WHEN o_orderkey % 35 = 0 THEN 'Done' WHEN o_orderkey % 10 = 0 THEN 'Pending'
              ELSE 'Paid' END AS status
  FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL
  SELECT o_orderkey * 4 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 2 END, o_orderkey, 'customer',
         CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1 ELSE o_custkey END, 'Cancelled'
  FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL
  SELECT o_orderkey * 4 + 3, o_orderkey, 'customer', o_custkey, 'Cancelled'
  FROM orders WHERE o_orderkey % 6 = 0),
employees AS (
  SELECT CAST(n_nationkey AS BIGINT) AS employee_id, n_name AS name,
         CASE n_nationkey % 4 WHEN 0 THEN 'Manager' WHEN 1 THEN 'Chef'
                              WHEN 2 THEN 'Waiter' ELSE 'Cashier' END AS role,
         '0191' || lpad(CAST(n_nationkey AS VARCHAR), 7, '0') AS phone,
         CAST(n_nationkey * 1000 + 18000 AS DECIMAL(10,2)) AS salary,
         DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS hire_date
  FROM nation),
orders AS (
  SELECT o_orderkey AS order_id,
         CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS customer_id,
         o_orderkey % 20 AS employee_id,
         o_orderdate AS order_date,
         CASE WHEN o_orderkey % 17 = 0 THEN 'Cancelled'
              WHEN o_orderstatus = 'F' THEN 'Paid'
              WHEN o_orderstatus = 'O' THEN 'Served' ELSE 'Pending' END AS status,
         CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount
  FROM orders),
order_items AS (
  SELECT row_id AS order_item_id, l_orderkey AS order_id, l_partkey AS menu_id,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(round(CAST(l_extendedprice AS DECIMAL(12,2))
                    * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(10,2)) AS price
  FROM li_ids),
users AS (
  SELECT c_custkey + 1 AS user_id, lower(c_name) AS username,
         sha256('pw' || CAST(c_custkey AS VARCHAR)) AS password,
         CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'customer' END AS role,
         CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS customer_id
  FROM customer),
cart_lines AS (
  SELECT order_id AS cart_id, menu_id, CAST(sum(quantity) AS INTEGER) AS qty
  FROM order_items GROUP BY order_id, menu_id),
login_attempts AS (
  SELECT c_custkey AS seq,
         CASE WHEN c_custkey % 7 = 0 THEN lower(c_name) || 'x'
              WHEN c_custkey % 5 = 0 THEN '  ' || lower(c_name) || ' '
              ELSE lower(c_name) END AS username,
         CASE WHEN c_custkey % 3 = 0 THEN 'wrong' ELSE 'pw' || CAST(c_custkey AS VARCHAR) END
           AS password
  FROM customer),
menu_changes AS (
  SELECT p_partkey AS seq,
         CASE WHEN p_partkey % 11 IN (0, 5) THEN 'update' WHEN p_partkey % 11 IN (1, 2) THEN 'add'
              WHEN p_partkey % 11 = 3 THEN 'delete' END AS op,
         CASE WHEN p_partkey % 11 IN (0, 3) THEN p_partkey
              WHEN p_partkey % 11 = 5 THEN p_partkey - 5 END AS menu_id,
         CASE WHEN p_partkey % 11 = 1 THEN (CASE WHEN p_partkey % 55 = 1 THEN '  '
                                                 ELSE p_name || ' special' END)
              WHEN p_partkey % 11 = 2 THEN p_name END AS name,
         CASE WHEN p_partkey % 11 IN (1, 2) THEN p_type END AS category,
         CAST(CASE WHEN p_partkey % 11 = 0 THEN (CASE WHEN p_partkey % 77 = 0 THEN 0
                                                      ELSE p_retailprice + p_size END)
                   WHEN p_partkey % 11 = 5 THEN p_retailprice + 1
                   WHEN p_partkey % 11 IN (1, 2) THEN p_retailprice END AS DECIMAL(10,2)) AS price,
         CAST(CASE WHEN p_partkey % 11 = 0 THEN (CASE WHEN p_partkey % 121 = 0 THEN 150
                                                      ELSE (p_size % 3) * 10 END)
                   WHEN p_partkey % 11 = 5 THEN 5
                   WHEN p_partkey % 11 IN (1, 2) THEN (CASE WHEN p_partkey % 33 = 1 THEN -5
                                                            ELSE (p_size % 4) * 5 END)
              END AS DECIMAL(5,2)) AS discount,
         CAST(CASE WHEN p_partkey % 11 = 0 THEN (CASE WHEN p_size % 2 = 0 THEN 1 END)
                   WHEN p_partkey % 11 = 5 THEN 1 END AS INTEGER) AS is_available
  FROM part WHERE p_partkey % 11 IN (0, 1, 2, 3, 5)),
ingredient_changes AS (
  SELECT p_partkey AS seq,
         CASE p_partkey % 13 WHEN 0 THEN 'update' WHEN 1 THEN 'add' WHEN 2 THEN 'delete' END AS op,
         CASE WHEN p_partkey % 13 IN (0, 2) THEN p_partkey END AS ingredient_id,
         CASE WHEN p_partkey % 13 = 1 THEN (CASE WHEN p_partkey % 26 = 1 THEN 'new ' || p_name
              ELSE 'new ' || p_name || ' #' || CAST(p_partkey AS VARCHAR) END) END AS name,
         CASE WHEN p_partkey % 13 = 1 THEN 'kg' END AS unit,
         CAST(CASE WHEN p_partkey % 13 = 0 THEN p_size + 5 WHEN p_partkey % 13 = 1 THEN p_size END
              AS DECIMAL(10,2)) AS quantity,
         CAST(CASE WHEN p_partkey % 13 = 0 THEN 12 WHEN p_partkey % 13 = 1 THEN 5 END
              AS DECIMAL(10,2)) AS reorder_level,
         CAST(CASE WHEN p_partkey % 13 = 0 THEN (CASE WHEN p_partkey % 39 = 0 THEN -1
                                                      ELSE p_retailprice END)
                   WHEN p_partkey % 13 = 1 THEN p_retailprice END AS DECIMAL(10,2)) AS unit_price,
         CASE WHEN p_partkey % 13 = 1 AND p_partkey % 3 <> 0 THEN p_partkey % 100 END AS supplier_id
  FROM part WHERE p_partkey % 13 IN (0, 1, 2)),
cart_events AS (
  SELECT l_orderkey AS cart_id, row_id AS seq,
         CASE WHEN l_linenumber % 4 = 3 THEN 'set' WHEN l_linenumber % 6 = 5 THEN 'remove'
              ELSE 'add' END AS op,
         l_partkey AS menu_id,
         CAST(CASE WHEN l_linenumber % 4 = 3 THEN CAST(l_quantity AS INTEGER) - 20
                   WHEN l_linenumber % 6 = 5 THEN NULL
                   ELSE CAST(l_quantity AS INTEGER) % 7 END AS INTEGER) AS qty
  FROM li_ids),
customer_deletes AS (
  SELECT c_custkey AS customer_id FROM customer WHERE c_custkey % 9 = 4),
supplier_deletes AS (
  SELECT s_suppkey * 2 AS supplier_id FROM supplier WHERE s_suppkey % 4 = 1),
new_purchases AS (
  SELECT l_orderkey * 1048576 + row_number() OVER (
           PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                            l_quantity, l_extendedprice, l_shipdate) AS seq,
         CASE WHEN l_orderkey % 41 = 0 THEN -l_suppkey - 1 ELSE l_suppkey END AS supplier_id,
         CASE WHEN l_orderkey % 43 = 0 THEN -l_partkey - 1 ELSE l_partkey END AS ingredient_id,
         CAST(l_quantity - 3 AS DECIMAL(10,2)) AS quantity,
         CAST(CASE WHEN l_orderkey % 50 = 0 THEN -l_extendedprice ELSE l_extendedprice END
              AS DECIMAL(10,2)) AS cost,
         CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_shipdate AS DATE) END AS purchase_date
  FROM lineitem WHERE l_returnflag = 'A'),
employee_deletes AS (SELECT CAST(n_nationkey * 2 AS BIGINT) AS employee_id FROM nation),
ingredient_deletes AS (
  SELECT p_partkey + p_partkey % 2 * 1000000 AS ingredient_id FROM part WHERE p_partkey % 3 = 1),
price_log AS (
  SELECT p_partkey AS menu_id, TIMESTAMP '1990-01-01 00:00:00' AS valid_from,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price, CAST(0 AS DECIMAL(5,2)) AS discount,
         1 AS is_available FROM part
  UNION ALL
  SELECT p_partkey, TIMESTAMP '1997-01-01 00:00:00', CAST(p_retailprice + 10 AS DECIMAL(10,2)),
         CAST(0 AS DECIMAL(5,2)), 1 FROM part WHERE p_partkey % 3 = 0
  UNION ALL
  SELECT p_partkey, TIMESTAMP '1999-06-01 00:00:00', CAST(p_retailprice AS DECIMAL(10,2)),
         CAST(20 AS DECIMAL(5,2)), CASE WHEN p_partkey % 35 = 0 THEN 0 ELSE 1 END
  FROM part WHERE p_partkey % 5 = 0)
"""


def with_prefix(select_sql: str, extra_ctes: str = "") -> str:
    """PREFIX + optional extra CTEs (starting with a comma) + the SELECT."""
    return PREFIX + extra_ctes + "\n" + select_sql
