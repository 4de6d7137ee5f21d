from .columns import (
    date_parts,
    hash_slice,
    is_present,
    rows_differ,
    strip_cr,
    text_or_null,
)
from .numbering import number_rows

__all__ = [
    "date_parts", "hash_slice", "is_present", "number_rows",
    "rows_differ", "strip_cr", "text_or_null",
]
