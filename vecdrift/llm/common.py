"""What the operators of this subpackage share: table loading, bounded runs of texts, hashing columns.

Rows that an operator needs twice, or whose lineage it cuts, are written with ``materialize`` below the folder named by
``spark.checkpoint.dir`` (shared by driver and executors on a cluster) and read back, so a lost executor costs a
re-read, never a recomputation from a vanished local block.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import delete_at_exit, materialize, shared_dir

__all__ = ["SPACE", "WORD", "ascii_lower", "chunks", "delete_at_exit", "id_crc32", "materialize", "shared_dir", "table", "text_or_empty"]

#: ASCII white space, as the contracts of these operators spell it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def chunks(texts: list[str | None], characters: int = 2 << 20) -> Iterator[list[str | None]]:
    """Runs of a batch's texts of bounded total length (one long text is a run of its own), so numpy's work space is."""
    few: list[str | None] = []
    size = 0
    for text in texts:
        n = len(text or "") + 64
        if few and size + n > characters:
            yield few
            few, size = [], 0
        few.append(text)
        size += n
    if few:
        yield few


def id_crc32(column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale or collation."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
