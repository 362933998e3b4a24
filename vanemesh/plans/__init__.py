"""Named queries over the driver tables, each with its SQL twin where SQL can express it."""

from . import queries_basic, queries_detect, queries_ingest, queries_sequence, queries_spatial  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
