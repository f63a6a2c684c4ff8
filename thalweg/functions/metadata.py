"""Key/value metadata held inside a document row."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise_meta_key


def unique_map(entries: Column, keep: str = "last") -> Column:
    """Map of an array of ``{key, value}`` structs; the first or last of a repeated key wins.

    Sorting by key and position puts the winner last in its run, so the work
    stays n log n within the row and no rows move.
    """
    sign = 1 if keep == "last" else -1
    ordered = F.sort_array(
        F.transform(
            entries,
            lambda e, i: F.struct(e["key"].alias("key"), (i * sign).alias("pos"), e["value"].alias("value")),
        )
    )
    # transform over a one-element array binds the sorted list to a name.
    winners = F.transform(
        F.array(ordered),
        lambda run: F.filter(
            run,
            lambda e, i: (i == F.size(run) - 1) | (F.get(run, i + 1)["key"] != e["key"]),
        ),
    )[0]
    return F.map_from_entries(F.transform(winners, lambda e: F.struct(e["key"], e["value"])))


def meta_map(entries: Column | str, normalised: bool = False) -> Column:
    """Metadata entries as a map; the last of a repeated key wins."""
    column = F.col(entries) if isinstance(entries, str) else entries
    key = (lambda e: normalise_meta_key(e["key"])) if normalised else (lambda e: e["key"])
    named = F.filter(column, lambda e: e["key"].isNotNull())
    return unique_map(F.transform(named, lambda e: F.struct(key(e).alias("key"), e["value"].alias("value"))))


# Metadata keys in the order in which they are tried.
HUC_KEYS = ("HUC10", "huc10", "HUC", "huc")
VERSION_KEYS = ("model_version", "modelVersion", "Model Version")


def first_key(mapping: Column | str, keys: Sequence[str]) -> Column:
    """Value of the first key that is present, even where that value is null."""
    column = F.col(mapping) if isinstance(mapping, str) else mapping
    found = F.lit(None).cast("string")
    for name in reversed(keys):
        found = F.when(F.map_contains_key(column, name), F.element_at(column, name)).otherwise(found)
    return found
