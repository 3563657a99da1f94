"""Raw records of unknown and differing shape as VARIANT.

Collectors' answers come in as many shapes as there are sources, and change without notice.  Here they
land in one table with one text column; ``parsed`` turns the text into a VARIANT once, fields of any
depth are read by dotted paths, and the shapes present are found by an aggregate instead of a fixed
schema.  Missing fields, malformed records and nulls give '' as dotted lookups do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, raw: str = "raw", out: str = "record") -> DataFrame:
    """``df`` with its JSON text as VARIANT; malformed text gives null."""
    return df.withColumn(out, F.try_parse_json(raw))


def variant_path(path: str) -> str:
    """JSON path of a dotted one: ``items.0.snippet.title``; a number is a place in a list."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))


def value(record, path: str, kind: str = "string") -> Column:
    """The field at a dotted path, or null; objects and lists come as JSON text."""
    return F.try_variant_get(record, variant_path(path), kind)


def text(record, path: str) -> Column:
    """The field as text, '' where there is none."""
    return F.coalesce(value(record, path), F.lit(""))


def first_of(record, *paths: str) -> Column:
    """The first field that is there and not empty."""
    return F.coalesce(*[F.nullif(value(record, p), F.lit("")) for p in paths])


def shapes(df: DataFrame, kind: str, record: str = "record") -> DataFrame:
    """The schema that the records of each kind have together, and how many there are."""
    return df.groupBy(kind).agg(F.schema_of_variant_agg(record).alias("shape"), F.count(F.lit(1)).alias("n_records"),
                                F.count_if(F.col(record).isNull()).alias("n_malformed"))


def flatten(df: DataFrame, fields: dict[str, list[str]], record: str = "record", keep=()) -> DataFrame:
    """One column for each of ``fields``, from the first of its paths that a record holds: records of all
    shapes meet in one projection, without a schema or a branch for each source."""
    return df.select(*keep, *[first_of(record, *paths).alias(name) for name, paths in fields.items()])
