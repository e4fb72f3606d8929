"""Registered queries: one per operator of the inventory, each with the
DuckDB SQL that must give the same rows (written in the naive form: theta
joins and whole-contig windows, so the fast Spark rewrite is really tested).

Every query reads the driver tables (through the fixture views) and so
grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _load() -> None:
    from . import basics, genomics, formats, homology, somatic, peaks, sv_cnv, phylo, spatial  # noqa: F401


_load()
