"""Messages into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions import date_parts
from orderloom.schemas import ACCEPTED_SUGGESTION
from orderloom.sources.topics import from_topic


def accepted_suggestions(records: DataFrame, as_of: str | None = None) -> DataFrame:
    """Accepted suggestions, laid out by the day they came in."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return date_parts(from_topic(records, ACCEPTED_SUGGESTION), day)
