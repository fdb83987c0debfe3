"""All registered queries and their oracles."""

from scrubline.queries import cleaning, files, reports, streams
from scrubline.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "files", "reports", "streams"]
