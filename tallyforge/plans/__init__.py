"""Named queries over the given tables. Importing this package registers them all."""

from tallyforge.plans import memory, rebuild, series, telemetry, text, trace  # noqa: F401
from tallyforge.plans.registry import QUERIES, SQL

from tallyforge.plans import files  # noqa: F401, I001 - rereads rows of the queries above

__all__ = ["QUERIES", "SQL"]
