"""What the corpus operators share: session settings, scratch tables and word rules.

Text rules follow the operators' contracts and are byte-wise, so that they mean
the same in Spark, Python and SQL: only A-Z are lower-cased, and white space is
the ASCII space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import prepare, scratch_path

# Rows and bytes handed to a Python worker at once: bounds memory when texts are long.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

# Alphanumeric words: every byte outside these ASCII ranges belongs to a word.
ALNUM_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Words between white space.
SPACE_SPLIT = r"[\x20\x09-\x0D]+"
SPACE_WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
LOWER_TABLE = bytes.maketrans(_UPPER, _LOWER)
# Lower-cases A-Z and turns every ASCII byte that belongs to no word into a space.
ALNUM_TABLE = bytes(
    LOWER_TABLE[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def ready(spark: SparkSession) -> SparkSession:
    """Apply the settings of the library and of the Python batches to a session."""
    prepare(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Later steps then start from files that any executor can read, so a lost
    executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hidden(df: DataFrame) -> list[Column]:
    """The columns of ``df`` under private numbered names, so that helper columns can stand beside them."""
    return [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(df.columns)]


def shown(df: DataFrame) -> list[Column]:
    """The columns that ``hidden(df)`` made, under their own names again."""
    return [F.col(f"_own{i}").alias(c) for i, c in enumerate(df.columns)]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text, 0 for NULL."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def alnum_words(text: str | None) -> list[bytes]:
    """The lower-cased alphanumeric words of a text as UTF-8 bytes; none for NULL."""
    return text.encode("utf-8").translate(ALNUM_TABLE).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """The lower-cased words between white space as UTF-8 bytes; none for NULL."""
    return text.encode("utf-8").translate(LOWER_TABLE).split() if text else []
