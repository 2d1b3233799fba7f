"""Reading, settling and the word and size rules that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mound.operators.attach import settle as settle

# Fixed values of the contract: what parts words, as a Java and RE2 class and for Python.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The wanted columns of a table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_of(column: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(column, upper, upper.lower())


def row_hash(seed: int, *columns: str) -> Column:
    """A 64-bit hash of the row that seeds draws and shuffles; nulls are hashed by place."""
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def cut(hashed: Column, parts: Column | int) -> Column:
    """0 to parts - 1, each for an equal share of the hashes."""
    return F.pmod(hashed, parts if isinstance(parts, Column) else F.lit(parts)).cast("int")
