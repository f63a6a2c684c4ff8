"""Registered queries over the shared test tables, and their SQL counterparts."""

from __future__ import annotations


def _load():
    from . import catalogs, registry, river, rollups  # noqa: F401

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
