"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# trained models and the like: tests compare these with brute force or held-out labels
NO_SQL = {"trained_ensemble", "trained_vote_summary", "member_accuracy"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def load_all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # importing the modules fills QUERIES
    from postlens.plans import (queries_core, queries_history, queries_io, queries_items, queries_landed, queries_members,  # noqa: F401
                                queries_raw, queries_rel, queries_scalar, queries_streams)
    return QUERIES
