"""Importing this module registers every query."""

from bindings import (  # noqa: F401
    shapes_cte,
    shapes_joins,
    shapes_sets,
    shapes_subqueries,
    shapes_windows,
    activity,
    corpus,
    curation,
    evaluation,
    profiles,
    retrieval,
    sqltext,
    storage,
    synthetic,
)
