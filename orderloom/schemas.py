"""Column lists of the source tables and messages, as Spark DDL strings.

Fixed values: names and types must equal those of the systems we read from.
"""

SOURCE_TABLES = {
    "stores": "id int, name string, address string, district string, city string, updated_at timestamp_ntz",
    "payment_method": "id int, method_name string, bank string, updated_at timestamp_ntz",
    "product_category": "id int, name string, updated_at timestamp_ntz",
    "products": "id string, name string, category_id int, unit_price int, updated_at timestamp_ntz",
    "customers": "id int, name string, phone_number int, tier string, updated_at timestamp_ntz",
    "orders": (
        "id string, `timestamp` timestamp_ntz, customer_id int, store_id int, "
        "payment_method_id int, num_products int"
    ),
    "order_details": (
        "order_id string, product_id string, quantity int, discount_percent int, "
        "subtotal int, is_suggestion boolean"
    ),
}

# Message bodies.
READY_ORDER = "order_id string, customer_id string, payment_method_id string, product_ids array<string>"
SUGGESTION = (
    "order_id string, product_id string, product_name string, quantity int, unit_price int, "
    "discount_percent int, subtotal int, is_suggestion boolean"
)
ACCEPTED_SUGGESTION = (
    "order_id string, product_id string, quantity int, discount_percent int, "
    "subtotal int, is_suggestion boolean"
)

# Row-change envelopes: `after` is the row as it now stands, null once deleted.
ORDER_CHANGE = (
    "payload struct<op: string, ts_ms: bigint, after: struct<id: string, customer_id: int, "
    "payment_method_id: int, num_products: int>>"
)
LINE_CHANGE = (
    "payload struct<op: string, ts_ms: bigint, after: struct<order_id: string, product_id: string>>"
)

LINE_COLUMNS = ["order_id", "product_id", "quantity", "discount_percent", "subtotal", "is_suggestion"]
DATE_PARTS = ["year", "month", "day"]
