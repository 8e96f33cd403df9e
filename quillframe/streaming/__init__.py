"""The dialect over streams.

Every expression is a function of one row, so WHERE and the projection of a
SELECT, and all of UPDATE and ALTER, run unchanged on a streaming DataFrame.
Sorting and limits need all rows and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import statements
from ..plans.nodes import Select
from ..plans.parser import parse_query


def over_stream(stream: DataFrame, text: str) -> DataFrame:
    """The stream that a statement makes of another. The words after FROM are not looked at."""
    q = parse_query(text)
    if isinstance(q, Select):
        if q.sort or q.limit:
            raise ValueError("a stream can't be sorted or cut")
        return statements.select(stream, q)
    return statements.mutate(stream, q)
