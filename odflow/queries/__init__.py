"""One runnable query per operator, each with its SQL counterpart where SQL can say it."""

from odflow.queries import explore, features, ingest, serve, spatial, stream, trends, validate  # noqa: F401
from odflow.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
