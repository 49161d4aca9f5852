"""Named queries over the given tables, each with an ANSI SQL twin if SQL can
say the same."""

from layerflow.queries.base import QUERIES, Query

from layerflow.queries import events, govern, merging, models, quality, scans, shaping, stored, streams  # noqa: F401, E402

__all__ = ["QUERIES", "Query"]
