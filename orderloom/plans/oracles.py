"""The same queries in plain SQL over the given tables, for comparison."""

from __future__ import annotations

from orderloom.config import BRONZE_RULES, SILVER_RULES, Rule
from orderloom.plans.driver_views import AS_OF, CUTOFF, T0, T1

STAMP0 = f"TIMESTAMP '{T0}'"
STAMP1 = f"TIMESTAMP '{T1}'"
CUT = f"TIMESTAMP '{CUTOFF}'"
CR = "chr(13)"

# Building blocks in dependency order: name -> (needed blocks, query).
BLOCKS: dict[str, tuple[str, str]] = {
    "stores": ("", f"""
        SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS name, 'Addr ' || CAST(s_suppkey AS VARCHAR) AS address,
               n_name AS district, CASE WHEN s_suppkey % 3 = 0 THEN r_name || {CR} ELSE r_name END AS city,
               {STAMP0} AS updated_at
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "payment_method": ("", f"""
        SELECT id, CASE id WHEN 1 THEN 'cash' WHEN 2 THEN 'credit' ELSE 'bank transfer' END AS method_name,
               CASE id WHEN 1 THEN 'null' WHEN 2 THEN 'null' || {CR} WHEN 3 THEN 'ACB' || {CR}
                       WHEN 4 THEN 'BIDV' ELSE 'MB Bank' END AS bank, {STAMP0} AS updated_at
        FROM (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS id FROM orders)"""),
    "product_category": ("", f"""
        SELECT CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS id, p_type AS name, {STAMP0} AS updated_at
        FROM (SELECT DISTINCT p_type FROM part)"""),
    "products": ("product_category", f"""
        SELECT 'P' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name, c.id AS category_id,
               CAST(floor(p_retailprice) AS INTEGER) AS unit_price, {STAMP0} AS updated_at
        FROM part JOIN product_category c ON c.name = p_type"""),
    "customers": ("", f"""
        SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS name, 0 AS phone_number,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'diamond' WHEN 'AUTOMOBILE' THEN 'gold'
                    WHEN 'MACHINERY' THEN 'silver' ELSE 'regular' END AS tier, {STAMP0} AS updated_at
        FROM customer"""),
    "src_orders": ("", """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS "timestamp",
               CAST(o_custkey AS INTEGER) AS customer_id,
               CAST(o_custkey % (SELECT count(*) FROM supplier) AS INTEGER) AS store_id,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS payment_method_id,
               CAST(coalesce(n, 0) AS INTEGER) AS num_products
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
          ON l_orderkey = o_orderkey"""),
    "order_details": ("", """
        SELECT CAST(l_orderkey AS VARCHAR) AS order_id, 'P' || CAST(l_partkey AS VARCHAR) AS product_id,
               CAST(floor(l_quantity) AS INTEGER) AS quantity,
               CAST(round(l_discount * 100) AS INTEGER) AS discount_percent,
               CAST(floor(l_extendedprice * (1 - l_discount)) AS INTEGER) AS subtotal,
               l_returnflag = 'R' AS is_suggestion
        FROM lineitem"""),
    "brz_orders": ("src_orders", """
        SELECT *, CAST(year("timestamp") AS INTEGER) AS year, CAST(month("timestamp") AS INTEGER) AS month,
               CAST(day("timestamp") AS INTEGER) AS day
        FROM src_orders"""),
    "old_top": ("src_orders", f"""
        SELECT max("timestamp") AS top FROM src_orders WHERE "timestamp" < {CUT}"""),
    "new_orders": ("brz_orders old_top", """
        SELECT * FROM brz_orders WHERE "timestamp" > (SELECT top FROM old_top)"""),
    "brz_details": ("brz_orders order_details", """
        SELECT d.*, o.year, o.month, o.day FROM order_details d JOIN brz_orders o ON o.id = d.order_id"""),
    "deliveries": ("", f"""
        SELECT event_type,
               CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS order_id,
               CASE WHEN event_type = 'error' THEN NULL ELSE 'P' || json_extract_string(props, '$.k') END AS product_id,
               CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE 1 END AS quantity,
               CASE WHEN event_type = 'error' THEN NULL
                    ELSE CAST(20 + user_id % 31 AS INTEGER) END AS discount_percent,
               CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 100) AS INTEGER) END AS subtotal,
               CASE WHEN event_type = 'error' THEN NULL ELSE TRUE END AS is_suggestion,
               CAST(year(DATE '{AS_OF}') AS INTEGER) AS year, CAST(month(DATE '{AS_OF}') AS INTEGER) AS month,
               CAST(day(DATE '{AS_OF}') AS INTEGER) AS day
        FROM events, (VALUES (1), (2)) AS copies (delivery)
        WHERE delivery = 1 OR event_type = 'click'"""),
    "once": ("deliveries", "SELECT DISTINCT * EXCLUDE (event_type) FROM deliveries"),
    "unseen": ("once brz_details deliveries", """
        SELECT s.* FROM once s WHERE NOT EXISTS (
            SELECT 1 FROM deliveries l WHERE l.event_type = 'purchase' AND l.order_id IS NOT DISTINCT FROM s.order_id
              AND l.product_id IS NOT DISTINCT FROM s.product_id
              AND l.is_suggestion IS NOT DISTINCT FROM s.is_suggestion)"""),
    "slv_details": ("unseen brz_details new_orders src_orders", f"""
        SELECT d.* FROM brz_details d JOIN new_orders o ON o.id = d.order_id
        UNION ALL
        SELECT u.* FROM unseen u WHERE NOT EXISTS (
            SELECT 1 FROM brz_details d JOIN src_orders o ON o.id = d.order_id
            WHERE o."timestamp" < {CUT} AND d.order_id IS NOT DISTINCT FROM u.order_id
              AND d.product_id IS NOT DISTINCT FROM u.product_id
              AND d.is_suggestion IS NOT DISTINCT FROM u.is_suggestion)"""),
    "products_v1": ("products", "SELECT * FROM products WHERE CAST(substr(id, 2) AS BIGINT) % 7 <> 0"),
    "products_v2": ("products", f"""
        SELECT id, name, category_id,
               unit_price + CASE WHEN CAST(substr(id, 2) AS BIGINT) % 10 = 0 THEN 1000 ELSE 0 END AS unit_price,
               CASE WHEN CAST(substr(id, 2) AS BIGINT) % 10 = 0 THEN {STAMP1} ELSE {STAMP0} END AS updated_at
        FROM products WHERE id <> 'P3'"""),
    "stores_v1": ("stores", "SELECT * FROM stores WHERE id % 7 <> 0"),
    "stores_v2": ("stores", f"""
        SELECT id, name, CASE WHEN id % 10 = 0 THEN district ELSE address END AS address,
               CASE WHEN id % 10 = 0 THEN address ELSE district END AS district, city,
               CASE WHEN id % 10 = 0 THEN {STAMP1} ELSE {STAMP0} END AS updated_at
        FROM stores WHERE id <> 3"""),
    "payment_method_v1": ("payment_method", "SELECT * FROM payment_method WHERE id <> 5"),
    "payment_method_v2": ("payment_method", f"""
        SELECT id, method_name, CASE id WHEN 1 THEN 'VCB' WHEN 4 THEN 'null' ELSE bank END AS bank,
               CASE WHEN id IN (1, 4) THEN {STAMP1} ELSE {STAMP0} END AS updated_at
        FROM payment_method WHERE id <> 2"""),
    "ready": ("src_orders order_details", """
        SELECT o.id AS order_id, CAST(o.customer_id AS VARCHAR) AS customer_id,
               CAST(o.payment_method_id AS VARCHAR) AS payment_method_id, coalesce(d.ids, []) AS ids
        FROM src_orders o LEFT JOIN (
            SELECT order_id, list_sort(list(DISTINCT product_id)) AS ids FROM order_details GROUP BY order_id
        ) d ON d.order_id = o.id
        WHERE coalesce(len(d.ids), 0) = o.num_products"""),
    "eligible": ("ready customers payment_method", """
        SELECT * FROM ready
        WHERE customer_id <> '' AND payment_method_id <> ''
          AND customer_id IN (SELECT CAST(id AS VARCHAR) FROM customers WHERE tier = 'diamond')
          AND payment_method_id IN (SELECT CAST(id AS VARCHAR) FROM payment_method WHERE bank LIKE '%ACB%')"""),
    "catalogue": ("products", "SELECT list_sort(list(id)) AS ids FROM products"),
    "suggested": ("eligible catalogue products", """
        SELECT c.order_id, p.id AS product_id, p.name AS product_name, 1 AS quantity, p.unit_price, c.discount_percent,
               CAST(CAST(p.unit_price AS BIGINT) * (100 - c.discount_percent) // 100 AS INTEGER) AS subtotal,
               TRUE AS is_suggestion
        FROM (
            SELECT order_id, free[('0x' || substr(md5(order_id), 1, 7))::BIGINT % len(free) + 1] AS pick,
                   CAST(20 + ('0x' || substr(md5(order_id), 8, 7))::BIGINT % 31 AS INTEGER) AS discount_percent
            FROM (SELECT order_id, list_filter(k.ids, lambda x: NOT list_contains(e.ids, x)) AS free
                  FROM eligible e, catalogue k)
            WHERE len(free) > 0
        ) c JOIN products p ON p.id = c.pick"""),
}


def _latest(block: str) -> str:
    return (
        f"(SELECT * FROM {block} QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"
    )


def _both(name: str) -> str:
    return f"SELECT * FROM {name}_v1 UNION ALL SELECT * FROM {name}_v2"


def _clean_products(block: str) -> str:
    return f"""
        SELECT p.id AS product_id, p.name AS product_name, c.name AS category, p.unit_price, p.updated_at
        FROM {_latest(block)} p LEFT JOIN product_category c ON c.id = p.category_id"""


def _clean_stores(block: str) -> str:
    return f"""
        SELECT id AS store_id, name AS store_name, address, district,
               regexp_replace(city, '\\r$', '') AS city, updated_at
        FROM {_latest(block)}"""


def _clean_methods(block: str) -> str:
    return f"""
        SELECT id AS method_id, method_name,
               CASE WHEN bank IN ('null', 'null' || {CR}) THEN NULL
                    ELSE regexp_replace(bank, '\\r$', '') END AS bank, updated_at
        FROM {_latest(block)}"""


for _name, _clean in (("products", _clean_products), ("stores", _clean_stores), ("payment_method", _clean_methods)):
    _extra = " product_category" if _name == "products" else ""
    for _suffix in ("", "_v1", "_v2"):
        BLOCKS[f"slv_{_name}{_suffix}"] = (f"{_name}{_suffix}{_extra}", _clean(f"{_name}{_suffix}"))
    BLOCKS[f"{_name}_both"] = (f"{_name}_v1 {_name}_v2", _both(_name))

_DIMENSIONS = {
    "products": ("product_key", "product_id", ["product_name", "category", "unit_price"]),
    "stores": ("store_key", "store_id", ["store_name", "address", "district", "city"]),
    "payment_method": ("method_key", "method_id", ["method_name", "bank"]),
}


def _initial(name: str, version: str = "") -> str:
    surrogate, key, attributes = _DIMENSIONS[name]
    return f"""
        SELECT row_number() OVER (ORDER BY {key}) - 1 AS {surrogate}, {key}, {', '.join(attributes)},
               updated_at AS start_date, CAST(NULL AS VARCHAR) AS end_date, TRUE AS is_current
        FROM slv_{name}{version}"""


def _changed(name: str) -> str:
    _, key, attributes = _DIMENSIONS[name]
    differs = " OR ".join(f"s.{a} IS DISTINCT FROM t.{a}" for a in attributes)
    return f"""
        SELECT s.*, t.{key} IS NULL AS is_new FROM slv_{name}_v2 s LEFT JOIN slv_{name}_v1 t ON s.{key} = t.{key}
        WHERE t.{key} IS NULL OR {differs}"""


def _scd2(name: str) -> str:
    surrogate, key, attributes = _DIMENSIONS[name]
    listed = ", ".join(attributes)
    return f"""
        SELECT {surrogate}, {key}, {listed}, start_date,
               CASE WHEN {key} IN (SELECT {key} FROM changed_{name} WHERE NOT is_new) THEN '2024-02-01' END AS end_date,
               {key} NOT IN (SELECT {key} FROM changed_{name} WHERE NOT is_new) AS is_current
        FROM first_{name}
        UNION ALL
        SELECT (SELECT max({surrogate}) FROM first_{name}) + row_number() OVER (ORDER BY {key}),
               {key}, {listed}, updated_at, NULL, TRUE
        FROM changed_{name}"""


for _name in _DIMENSIONS:
    BLOCKS[f"dim_{_name}"] = (f"slv_{_name}", _initial(_name))
    BLOCKS[f"first_{_name}"] = (f"slv_{_name}_v1", _initial(_name, "_v1"))
    BLOCKS[f"changed_{_name}"] = (f"slv_{_name}_v1 slv_{_name}_v2", _changed(_name))
    BLOCKS[f"scd2_{_name}"] = (f"first_{_name} changed_{_name}", _scd2(_name))

BLOCKS["fact"] = ("brz_details brz_orders dim_products dim_stores dim_payment_method", """
        SELECT o.year, o.month, o.day, o."timestamp" AS order_date, o.id AS order_id, o.customer_id, s.store_key,
               m.method_key AS payment_method_key, p.product_key, d.quantity, d.subtotal
        FROM brz_orders o JOIN order_details d ON d.order_id = o.id
        JOIN dim_products p ON p.product_id = d.product_id
        JOIN dim_stores s ON s.store_id = o.store_id
        JOIN dim_payment_method m ON m.method_id = o.payment_method_id""")

def _fact_of(orders: str, lines: str, products: str) -> str:
    return f"""
        SELECT o.year, o.month, o.day, o."timestamp" AS order_date, o.id AS order_id, o.customer_id, s.store_key,
               m.method_key AS payment_method_key, p.product_key, d.quantity, d.subtotal
        FROM {orders} o JOIN {lines} d ON d.order_id = o.id JOIN {products} p ON p.product_id = d.product_id
        JOIN dim_stores s ON s.store_id = o.store_id JOIN dim_payment_method m ON m.method_id = o.payment_method_id"""


# What whole runs leave: lines with suggestions, and products whose second version was loaded by its time stamps.
_PLACED = "order_id, product_id, quantity, subtotal"
BLOCKS["all_lines"] = ("order_details once", f"""
        SELECT {_PLACED} FROM order_details UNION ALL SELECT {_PLACED} FROM once""")
BLOCKS["first_lines"] = ("order_details deliveries", f"""
        SELECT {_PLACED} FROM order_details UNION ALL
        SELECT {_PLACED} FROM (SELECT DISTINCT * FROM deliveries WHERE event_type = 'purchase')""")
BLOCKS["run_products"] = ("products_v1 products_v2", f"""
        SELECT * FROM products_v1 UNION ALL SELECT * FROM products_v2 WHERE updated_at = {STAMP1}""")
BLOCKS["slv_run_products"] = ("run_products product_category", _clean_products("run_products"))
BLOCKS["changed_run_products"] = ("slv_run_products slv_products_v1", """
        SELECT s.product_id FROM slv_run_products s LEFT JOIN slv_products_v1 t USING (product_id)
        WHERE t.product_id IS NULL OR s.unit_price <> t.unit_price""")
BLOCKS["second_products"] = ("first_products changed_run_products", """
        SELECT product_key, product_id FROM first_products
        WHERE product_id NOT IN (SELECT product_id FROM changed_run_products)
        UNION ALL
        SELECT (SELECT max(product_key) FROM first_products) + row_number() OVER (ORDER BY product_id), product_id
        FROM changed_run_products""")
BLOCKS["month_orders"] = ("src_orders", """
        SELECT *, CAST(year("timestamp") AS INTEGER) AS year, CAST(month("timestamp") AS INTEGER) AS month,
               CAST(day("timestamp") AS INTEGER) AS day
        FROM (SELECT * REPLACE (CAST(date_trunc('month', "timestamp") AS TIMESTAMP) + to_hours(day("timestamp") - 1) AS "timestamp")
              FROM src_orders)""")
BLOCKS["old_month_orders"] = ("month_orders", f"""SELECT * FROM month_orders WHERE "timestamp" < {CUT}""")
BLOCKS["new_month_orders"] = ("month_orders", f"""SELECT * FROM month_orders WHERE "timestamp" >= {CUT}""")

# Tables with flaws, for the quality rules.
BLOCKS["q_orders"] = ("src_orders", """
        SELECT * REPLACE (CASE WHEN customer_id % 16 <> 0 THEN customer_id END AS customer_id) FROM src_orders""")
BLOCKS["q_products"] = ("products_v1 products_v2", f"""
        SELECT * FROM products_v1 UNION ALL
        SELECT * FROM products_v2 WHERE updated_at = {STAMP1} OR id NOT IN (SELECT id FROM products_v1)""")
BLOCKS["q_again"] = ("src_orders", """
        SELECT id FROM src_orders UNION ALL SELECT id FROM src_orders WHERE customer_id % 4 = 0""")
BLOCKS["qs_products"] = ("q_products product_category", _clean_products("q_products"))
BLOCKS["qs_orders"] = ("q_orders", "SELECT * RENAME (id AS order_id) FROM q_orders")
BLOCKS["qs_details"] = ("brz_details once", "SELECT * FROM brz_details UNION ALL SELECT * FROM once")

_QUALITY_BLOCKS = {
    "brz": {
        "orders": "q_orders", "order_details": "order_details", "order_suggestion_accepted": "deliveries",
        "products": "q_products", "product_category": "product_category", "stores": "stores",
    },
    "slv": {
        "products": "qs_products", "stores": "slv_stores", "payment_method": "slv_payment_method",
        "orders": "qs_orders", "order_details": "qs_details",
    },
}


def _rule_sql(block: str, table: str, rule: Rule) -> str:
    c = rule.column
    head = f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{rule.kind}' AS rule, "
    if rule.kind == "null_ratio":
        return head + f"""CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) AS value,
            count(*) FILTER (WHERE {c} IS NULL) <= {rule.threshold} * count(*) AS passed,
            concat_ws(' ', count(*) FILTER (WHERE {c} IS NULL), 'of', count(*), 'values are NULL') AS message
            FROM {block}"""
    if rule.kind == "completeness":
        return head + f"""CAST(count({c}) AS DOUBLE) / count(*) AS value,
            CAST(count({c}) AS DOUBLE) / count(*) >= {rule.threshold} AS passed,
            concat_ws(' ', count({c}), 'of', count(*), 'values are present') AS message FROM {block}"""
    if rule.kind == "minimum":
        return head + f"""CAST(min({c}) AS DOUBLE) AS value, min({c}) >= {rule.threshold} AS passed,
            CASE WHEN min({c}) < {rule.threshold} THEN 'value below the minimum'
                 ELSE 'no value below the minimum' END AS message FROM {block}"""
    if rule.kind == "repeated_keys":
        return head + f"""CAST(count(*) AS DOUBLE) AS value, count(*) <= {rule.threshold} AS passed,
            concat_ws(' ', count(*), 'values occur more than once') AS message
            FROM (SELECT {c} FROM {block} GROUP BY {c} HAVING count(*) > 1)"""
    return head + f"""CAST(count(*) - count(DISTINCT {c}) AS DOUBLE) AS value,
        count(*) - count(DISTINCT {c}) <= {rule.threshold} AS passed,
        concat_ws(' ', count(DISTINCT {c}), 'distinct of', count(*), 'rows') AS message FROM {block}"""


def _rules(layer: str, *kinds: str, prefix: str = "") -> tuple[str, str]:
    rules = BRONZE_RULES if layer == "brz" else SILVER_RULES
    picked = [
        (_QUALITY_BLOCKS[layer][table], prefix + table, rule)
        for table, on_table in rules.items() for rule in on_table if not kinds or rule.kind in kinds
    ]
    blocks = " ".join(sorted({block for block, _, _ in picked}))
    return blocks, "\nUNION ALL\n".join(_rule_sql(*rule) for rule in picked)


def _query(blocks: str, body: str) -> str:
    needed: list[str] = []

    def add(name: str) -> None:
        for other in BLOCKS[name][0].split():
            add(other)
        if name not in needed:
            needed.append(name)

    for name in blocks.split():
        add(name)
    listed = ",\n".join(f"{n} AS ({BLOCKS[n][1]})" for n in needed)
    return f"WITH {listed}\n{body}" if needed else body


_READY = "SELECT order_id, customer_id, payment_method_id, array_to_string(ids, ',') AS product_ids FROM"
_ACCEPTED = "order_id, product_id, quantity, discount_percent, subtotal, is_suggestion"

_INSPECTED = [
    ("gld.dim_stores", "dim_stores", 9,
     "store_key bigint, store_id int, store_name string, address string, district string, city string, "
     "start_date timestamp_ntz, end_date date, is_current boolean"),
    ("gld.dim_products", "dim_products", 8,
     "product_key bigint, product_id string, product_name string, category string, unit_price int, "
     "start_date timestamp_ntz, end_date date, is_current boolean"),
    ("gld.dim_payment_method", "dim_payment_method", 7,
     "method_key bigint, method_id int, method_name string, bank string, "
     "start_date timestamp_ntz, end_date date, is_current boolean"),
    ("gld.fact_orders", "fact", 11,
     "year int, month int, day int, order_date timestamp_ntz, order_id string, customer_id int, store_key bigint, "
     "payment_method_key bigint, product_key bigint, quantity int, subtotal int"),
]
_INSPECT = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count, {n} AS column_count, '{columns}' AS columns, "
    f"CAST(NULL AS VARCHAR) AS error FROM {block}" for name, block, n, columns in _INSPECTED
) + "\nUNION ALL SELECT 'gld.missing', NULL, NULL, NULL, 'cannot read: AnalysisException'"

_PREVIEW_ORDER = {"fact": "order_id, product_key, quantity, subtotal", "dim_stores": "store_key",
                  "dim_products": "product_key", "dim_payment_method": "method_key"}


def _preview(name: str, block: str, columns: str) -> str:
    """Five rows as JSON, fields by name."""
    names = sorted(part.split()[0] for part in columns.split(", "))
    shown = ", ".join(f"{c} := {f'CAST({c} AS VARCHAR)' if c in ('start_date', 'end_date', 'order_date') else c}" for c in names)
    return (f"SELECT '{name}' AS table_name, CAST(to_json(struct_pack({shown})) AS VARCHAR) AS fields "
            f"FROM (SELECT * FROM {block} ORDER BY {_PREVIEW_ORDER[block]} LIMIT 5)")


_DRIFT = """
SELECT 'brz.order_details' AS table_name, column_name, change, expected_type, actual_type,
       CASE column_name WHEN 'coupon' THEN 0 WHEN 'subtotal' THEN count(subtotal) WHEN 'quantity' THEN count(quantity)
            ELSE count(discount_percent) END AS values_present
FROM order_details, (VALUES
    ('subtotal', 'retyped', 'bigint', 'int'), ('subtotal', 'moved', 'bigint', 'int'),
    ('quantity', 'moved', 'int', 'int'), ('coupon', 'removed', 'string', NULL),
    ('discount_percent', 'added', NULL, 'int')) AS d (column_name, change, expected_type, actual_type)
GROUP BY column_name, change, expected_type, actual_type"""

ORACLES: dict[str, str] = {
    "fact_orders_full": _query("fact", "SELECT * FROM fact"),
    "fact_orders_incremental": _query("fact", f"""
        SELECT * FROM fact WHERE order_date > (SELECT max(order_date) FROM fact WHERE order_date < {CUT})"""),
    "fact_orders_day_watermark": _query("fact", """
        , moved AS (
            SELECT * REPLACE (order_date + to_hours(customer_id % 24) AS order_date) FROM fact
        ), tops AS (
            SELECT max("timestamp" + to_hours(customer_id % 24)) AS top FROM src_orders
            WHERE "timestamp" + to_hours(customer_id % 24) < TIMESTAMP '2001-01-01 12:00:00'
        )
        SELECT * FROM moved WHERE CAST(order_date AS DATE) > (SELECT top FROM tops)""".lstrip()),
    "bronze_orders_full": _query("brz_orders", "SELECT * FROM brz_orders"),
    "bronze_orders_incremental": _query("new_orders", "SELECT * FROM new_orders"),
    "bronze_orders_ties": _query("brz_orders old_top", """
        SELECT * FROM brz_orders, old_top
        WHERE "timestamp" > top OR ("timestamp" = top AND customer_id % 2 <> 0)""").replace(
            "SELECT * FROM brz_orders, old_top", "SELECT brz_orders.* FROM brz_orders, old_top"),
    "bronze_details_incremental": _query("brz_details new_orders", """
        SELECT d.* FROM brz_details d WHERE d.order_id IN (SELECT id FROM new_orders)"""),
    "bronze_dim_incremental": _query("products_v1 products_v2", """
        SELECT *, CAST(year(updated_at) AS INTEGER) AS year, CAST(month(updated_at) AS INTEGER) AS month,
               CAST(day(updated_at) AS INTEGER) AS day
        FROM products_v2 WHERE updated_at > (SELECT max(updated_at) FROM products_v1)"""),
    "bronze_suggestions": _query("deliveries", "SELECT * EXCLUDE (event_type) FROM deliveries"),
    "ingest_csv_dim": _query("products product_category", f"""
        SELECT p.id, p.name || ', ' || c.name AS name, category_id, unit_price, {STAMP0} AS updated_at
        FROM products p JOIN product_category c ON c.id = p.category_id"""),
    "ingest_csv_rejects": _query("products", f"""
        SELECT 'products' AS table_name, id || ',"' || name || '",' || category_id
               || CASE WHEN category_id % 7 = 0 THEN ',n/a' ELSE '' END AS line, {STAMP0} AS rejected_at
        FROM products WHERE category_id % 7 = 0 OR category_id % 5 = 0"""),
    "silver_stores": _query("stores_both", _clean_stores("stores_both")),
    "silver_products": _query("products_both product_category", _clean_products("products_both")),
    "silver_payment_method": _query("payment_method_both", f"""
        SELECT *, CAST(year(updated_at) AS INTEGER) AS year, CAST(month(updated_at) AS INTEGER) AS month,
               CAST(day(updated_at) AS INTEGER) AS day
        FROM ({_clean_methods("payment_method_both")})"""),
    "silver_customers": _query("customers", "SELECT * FROM customers"),
    "silver_orders": _query("new_orders", "SELECT * RENAME (id AS order_id) FROM new_orders"),
    "silver_order_details": _query("slv_details", "SELECT * FROM slv_details"),
    "silver_suggestions_unseen": _query("unseen", "SELECT * FROM unseen"),
    "silver_suggestions_delta": _query("once deliveries", """
        SELECT o.* EXCLUDE (year, month, day), 2001 AS year, CASE WHEN EXISTS (
            SELECT 1 FROM deliveries l WHERE l.event_type = 'purchase' AND l.order_id IS NOT DISTINCT FROM o.order_id
              AND l.product_id IS NOT DISTINCT FROM o.product_id) THEN 6 ELSE 7 END AS month, 1 AS day
        FROM once o"""),
    "dim_payment_initial": _query("dim_payment_method", "SELECT * FROM dim_payment_method"),
    "dim_products_initial": _query("dim_products", "SELECT * FROM dim_products"),
    "dim_stores_initial": _query("dim_stores", "SELECT * FROM dim_stores"),
    "dim_products_changes": _query("changed_products", "SELECT * FROM changed_products"),
    "dim_payment_scd2": _query("scd2_payment_method", "SELECT * FROM scd2_payment_method"),
    "dim_products_scd2": _query("scd2_products", "SELECT * FROM scd2_products"),
    "dim_stores_scd2": _query("scd2_stores", "SELECT * FROM scd2_stores"),
    "dim_products_merge": _query("scd2_products", "SELECT * FROM scd2_products"),
    "run_fact_full": _query(
        "month_orders all_lines dim_products dim_stores dim_payment_method", _fact_of("month_orders", "all_lines", "dim_products")),
    "run_fact_delta": _query(
        "old_month_orders new_month_orders first_lines all_lines first_products second_products dim_stores dim_payment_method",
        _fact_of("old_month_orders", "first_lines", "first_products") + " UNION ALL "
        + _fact_of("new_month_orders", "all_lines", "second_products")),
    "dq_schema_drift": _query("order_details", _DRIFT),
    "dq_null_ratio": _query(*_rules("brz", "null_ratio")),
    "dq_duplicate_keys": _query(*_rules("brz", "repeated_keys")),
    "dq_completeness": _query(*_rules("slv", "completeness")),
    "dq_min": _query(*_rules("slv", "minimum")),
    "dq_uniqueness": _query(*_rules("slv", "uniqueness")),
    "dq_uniqueness_delta": _query("q_again", "\nUNION ALL\n".join(
        _rule_sql("q_again", "orders", Rule(kind, "id", 0)) for kind in ("repeated_keys", "uniqueness"))),
    "dq_report": _query(
        f"{_rules('brz')[0]} {_rules('slv')[0]}",
        f"{_rules('brz', prefix='brz.')[1]}\nUNION ALL\n{_rules('slv', prefix='slv.')[1]}",
    ),
    "inspect_tables": _query("dim_stores dim_products dim_payment_method fact", _INSPECT),
    "preview_tables": _query("dim_stores dim_products dim_payment_method fact", "\nUNION ALL\n".join(
        _preview(name, block, columns) for name, block, _, columns in _INSPECTED)),
    "ref_diamond_customers": _query("customers", "SELECT id FROM customers WHERE tier = 'diamond'"),
    "ref_acb_methods": _query("payment_method", "SELECT id FROM payment_method WHERE bank LIKE '%ACB%'"),
    "ref_products": _query("products", """
        SELECT id AS product_id, name AS product_name, unit_price FROM products"""),
    "rt_cdc_flatten": _query("src_orders order_details", """
        SELECT 'order' AS kind, id AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
               CAST(payment_method_id AS VARCHAR) AS payment_method_id, num_products,
               CAST(NULL AS VARCHAR) AS product_id
        FROM src_orders WHERE payment_method_id <> 5
        UNION ALL SELECT 'line', order_id, NULL, NULL, NULL, product_id FROM order_details"""),
    "rt_order_assembly": _query("ready", f"{_READY} ready"),
    "rt_eligible_orders": _query("eligible", f"{_READY} eligible"),
    "rt_recommendations": _query("suggested", "SELECT * FROM suggested"),
    "rt_suggestion_accepted": _query("suggested", f"SELECT {_ACCEPTED} FROM suggested"),
    "rt_assembly_stream": _query(
        "ready", "SELECT a.*, 1704067200 + CAST(order_id AS BIGINT) % 60 AS ready_at FROM "
        f"({_READY} ready) a WHERE payment_method_id <> '5'"
    ),
    "rt_assembly_resumed": _query(
        "ready", "SELECT a.*, 1704067200 + CAST(order_id AS BIGINT) % 60 AS ready_at FROM "
        f"({_READY} ready) a WHERE payment_method_id <> '5' AND (CAST(customer_id AS BIGINT) % 2 = 0 OR payment_method_id <= '3')"
    ),
}
