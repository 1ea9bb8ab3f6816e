"""What several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import clear, components, drop, scope, scratch, shared_folder, store

__all__ = ["SPACE", "WORD", "clear", "components", "drop", "quoted", "scope", "scratch", "shared_folder", "small_batches", "store", "words"]

#: Runs of these characters separate words and are folded by normalisation.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch, unless a single row has more, and the setting that bounds it.
BATCH = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let texts go to Python in batches of a few MB: by default one has 10,000 rows or 64 MB,
    which an executor holds several times for each task, in the JVM and in Python. A session
    that has a bound of its own keeps it. For the session."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BATCH))


def quoted(name: str) -> str:
    """A column's name, whatever characters it has, for col()."""
    return "`" + name.replace("`", "``") + "`"


def words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
