"""What the batch run works on: places, dimensions and quality rules."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Dimension:
    """A history-keeping dimension: its keys and the attributes whose change makes a new version."""

    name: str
    surrogate: str
    key: str
    attributes: tuple[str, ...]
    silver: str
    updated_at: str = "updated_at"

    @property
    def columns(self) -> list[str]:
        return [self.surrogate, self.key, *self.attributes, "start_date", "end_date", "is_current"]


PAYMENT_METHOD = Dimension(
    "dim_payment_method", "method_key", "method_id", ("method_name", "bank"), "payment_method"
)
STORES = Dimension(
    "dim_stores", "store_key", "store_id", ("store_name", "address", "district", "city"), "stores"
)
PRODUCTS = Dimension(
    "dim_products", "product_key", "product_id", ("product_name", "category", "unit_price"), "products"
)
DIMENSIONS = (PAYMENT_METHOD, STORES, PRODUCTS)


@dataclass(frozen=True)
class Rule:
    """One quality rule on one column.

    ``null_ratio``     share of NULLs must not exceed ``threshold``
    ``repeated_keys``  number of values seen more than once must not exceed ``threshold``
    ``completeness``   share of non-NULLs must reach ``threshold``
    ``minimum``        smallest value must reach ``threshold``
    ``uniqueness``     rows minus distinct non-NULL values must not exceed ``threshold``
    """

    kind: str
    column: str
    threshold: float


def _rules(nulls=(), repeated=(), complete=(), minimum=(), unique=()):
    return [
        *(Rule("null_ratio", c, 0.05) for c in nulls),
        *(Rule("repeated_keys", c, 0) for c in repeated),
        *(Rule("completeness", c, 1.0) for c in complete),
        *(Rule("minimum", c, 0) for c in minimum),
        *(Rule("uniqueness", c, 0) for c in unique),
    ]


# The checked columns of each layer.
BRONZE_RULES = {
    "orders": _rules(nulls=["id", "customer_id", "payment_method_id", "store_id"], repeated=["id"]),
    "order_details": _rules(nulls=["order_id", "product_id", "quantity", "subtotal"]),
    "order_suggestion_accepted": _rules(nulls=["order_id", "product_id", "quantity", "subtotal"]),
    "products": _rules(nulls=["id", "name", "category_id", "unit_price", "updated_at"], repeated=["id"]),
    "product_category": _rules(nulls=["id", "updated_at"], repeated=["id"]),
    "stores": _rules(nulls=["id", "address", "district", "city", "updated_at"], repeated=["id"]),
}
SILVER_RULES = {
    "products": _rules(
        complete=["product_id", "product_name", "category", "updated_at"],
        minimum=["unit_price"],
        unique=["product_id"],
    ),
    "stores": _rules(
        complete=["store_id", "address", "district", "city", "updated_at"], unique=["store_id"]
    ),
    "payment_method": _rules(complete=["method_id", "updated_at"], unique=["method_id"]),
    "orders": _rules(
        complete=["order_id", "store_id", "customer_id", "payment_method_id"], unique=["order_id"]
    ),
    "order_details": _rules(
        complete=["order_id", "product_id", "quantity", "subtotal"], minimum=["subtotal"]
    ),
}

#: Tables that grow behind a watermark: their keys are counted as they come.
GROWING = ("orders",)
BRONZE_DIMENSIONS = ("stores", "product_category", "products", "payment_method", "customers")


@dataclass(frozen=True)
class Endpoint:
    """Where a table or topic lives: a Spark format and its options.

    For ``jdbc`` tables and ``kafka`` topics the name is filled in by the reader;
    file formats take ``{path}/{name}``.
    """

    format: str
    options: dict = field(default_factory=dict)
    path: str | None = None
    table_options: dict = field(default_factory=dict)  # per table: partitioning or predicates


@dataclass(frozen=True)
class Lake:
    """Layer roots on storage every executor can reach."""

    root: str
    source: Endpoint
    topics: Endpoint
    #: How dimensions are kept: "snapshot" (each change a new copy), "merged" (only what changed is written),
    #: or a transactional format that the session has.
    table_format: str = "snapshot"

    def bronze(self, table: str) -> str:
        return f"{self.root}/bronze/brz.{table}"

    def silver(self, table: str) -> str:
        return f"{self.root}/silver/slv.{table}"

    def gold(self, table: str) -> str:
        return f"{self.root}/gold/gld.{table}"

    def keys(self, layer: str, table: str, column: str) -> str:
        return f"{self.root}/_keys/{layer}.{table}.{column}"

    def rejects(self, table: str) -> str:
        return f"{self.root}/rejects/{table}"

    def progress(self, query: str) -> str:
        return f"{self.root}/_progress/{query}"

    @property
    def schema_store(self) -> str:
        return f"{self.root}/_schemas/bronze"
