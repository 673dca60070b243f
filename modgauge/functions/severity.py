"""Severity levels: info < warning < critical."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values, lowest first.
INFO, WARNING, CRITICAL = "info", "warning", "critical"
LEVELS = (INFO, WARNING, CRITICAL)


def severity_rank(text: Column) -> Column:
    """0, 1 or 2; any case is accepted and an unknown word counts as info."""
    word = F.lower(text)
    return F.when(word == CRITICAL, 2).when(word == WARNING, 1).otherwise(0)


def rank_of(word: str) -> int:
    """severity_rank for a driver-side argument."""
    word = word.lower()
    return LEVELS.index(word) if word in LEVELS else 0


def severity_label(rank: Column) -> Column:
    return F.when(rank == 2, CRITICAL).when(rank == 1, WARNING).otherwise(INFO)
