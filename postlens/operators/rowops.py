"""Row-level plan helpers: parallelism of CPU-heavy scans and filters on computed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PARTITIONS = "postlens.scan.partitions"


def spread(df: DataFrame, key: str | None = None, partitions: int | None = None) -> DataFrame:
    """Hash-partition ``df`` on ``key`` into ``partitions``, if asked for.

    Off unless the caller or the session (``postlens.scan.partitions``) names a number: a table's
    splits are the deployment's business, and a shuffle of whole texts only pays for small tables that
    are stored as one row group.  The data's size never switches it on.
    """
    n = partitions or int(df.sparkSession.conf.get(PARTITIONS, "0"))
    if not n:
        return df
    return df.repartition(n, key) if key else df.repartition(n)


def where_computed(df: DataFrame, pred) -> DataFrame:
    """Filter on columns computed by earlier projections without re-deriving them.

    ``df.where(c)`` on a computed column is pushed below the projection and the expression is
    inlined into the filter, so an expensive expression (a chain of regexes) runs twice per row.
    Here the predicate is evaluated inside a generator over the already computed row, which the
    optimizer cannot push down: each row yields itself or nothing.

    ``pred`` maps the row struct to a boolean Column, e.g. ``lambda r: F.length(r["content"]) > 0``.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.inline(F.filter(F.array(row),
                                       lambda r: F.coalesce(pred(r), F.lit(False)))))


def barrier(df: DataFrame) -> DataFrame:
    """Stop later filters on computed columns from being pushed back into (and re-evaluating) the
    projections that computed them; each row passes through a one-element generator unchanged."""
    return where_computed(df, lambda r: F.lit(True))
