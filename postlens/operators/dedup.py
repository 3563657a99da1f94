"""Order-dependent de-duplication (W1-W4) and incremental anti joins.

"First wins" / "last wins" are aggregates, not window ranks: ``groupBy(key).agg(min_by(col,
seq), ...)`` runs a partial aggregate on every map task before the shuffle, so a key that holds a
third of all rows reaches the reducer as one row per map task instead of as a third of the data
(a ``row_number`` window would sort the whole hot group in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(cols) -> Column:
    """256-bit digest of some columns; null and empty differ"""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def first_rows(df: DataFrame, keys, order: str = "ingest_seq") -> DataFrame:
    """W1 for wide rows: the whole row with the smallest ``order`` of each key.

    Groups are formed on a digest of the key, so no text is shuffled to find them; the winners' rows
    are then fetched by their ``order``, which must be unique.
    """
    win = df.select(order, row_digest(keys).alias("_key")).groupBy("_key").agg(F.min(order).alias(order))
    return df.join(win.select(order), order, "left_semi")


def keep_first(df: DataFrame, keys, order: str = "ingest_seq") -> DataFrame:
    """One row per ``keys``: the row with the smallest ``order``.

    ``order`` must be unique (a sequence number), so picking every column with ``min_by`` on it
    picks one row.  Per-column ``min_by`` keeps fixed-width aggregation buffers when the carried
    columns are numeric, which lets Spark use a hash aggregate instead of a sort aggregate.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.min_by(c, F.col(order)).alias(c) for c in rest])


def keep_last(df: DataFrame, keys, order: str = "ingest_seq") -> DataFrame:
    """One row per ``keys``: the row with the largest ``order``; ``first_seq`` keeps the position
    where the key was first seen (dict-overwrite order)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(c, F.col(order)).alias(c) for c in rest],
                                 F.min(order).alias("first_seq"))


def new_only(df: DataFrame, seen: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not in ``seen`` (left anti join; Spark broadcasts ``seen`` only when
    its measured size is under the broadcast threshold, else sort-merge)."""
    return df.join(seen.select(key).distinct(), key, "left_anti")
