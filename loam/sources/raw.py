"""Raw save tables: identity of a revision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revision_id(*parts: str) -> Column:
    """SHA-256 of the newline-joined identity parts."""
    return F.sha2(F.concat_ws("\n", *[F.col(p).cast("string") for p in parts]).cast("binary"), 256)
