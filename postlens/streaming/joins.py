"""Hits, details and comments that land apart, joined as streams.

Each side has an event time and a watermark; a row waits in state until its partner lands or the
watermark says that it won't any more, and an unmatched hit then goes out with nulls (left outer).  The
joins are bounded in time (``within``), so state is freed.  Nothing goes out for rows that the
watermark has not passed yet: to close, every side lands a row (``closing_rows``) far later than all others,
whose key is no other's, and the stream is run once more for each join in the chain and once at the end,
as the outer rows of one join only then reach the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSING_KEY = -1


def closing_rows(rows: DataFrame, key: str, ts: str, later: str) -> DataFrame:
    """One row ``later`` than all of ``rows``, with nulls elsewhere (none if there are no rows)."""
    end = rows.agg(F.max(ts).alias("_end")).where("_end is not null").select(F.expr(f"_end + interval {later}").alias("_at"))
    return end.select(*[F.lit(CLOSING_KEY).cast(f.dataType).alias(f.name) if f.name == key else F.col("_at").alias(f.name) if f.name == ts
                        else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def outer_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, right_key: str, delay: str, within: str) -> DataFrame:
    """Left rows with their partners within ``within`` to either side, or nulls when none came.  Closing
    rows are to be left out by the reader: a filter here would be pushed below the watermark, which would
    then not see them."""
    a, b = left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay)
    near = F.expr(f"{right_key} = {key} AND {right_ts} >= {left_ts} - interval {within} AND {right_ts} <= {left_ts} + interval {within}")
    return a.join(b, near, "left_outer")
