"""Column expressions shared by the operators; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD, GAP, BLANKS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r"


def whole(text: Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def all_columns(docs: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    trimmed = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def code_points(text: Column) -> Column:
    return F.char_length(whole(text)).cast("long")


def hash60(*parts: Column) -> Column:
    """The first 60 bits of an MD5 as a long; parts are joined by a byte that separates them."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("long")


def table_column(spark: SparkSession, values: list[float], kind: str = "double") -> Column:
    """A fixed-size lookup table as a scalar subquery; its length is a parameter of the caller, not of the data.

    Plans show a subquery by its number, a literal by its values: the driver keeps the text of every plan, several times over.
    Lambda functions take it by the name of a column only.
    """
    held = [float(f"{v:.6g}") for v in values] if kind == "double" else list(values)
    return spark.createDataFrame([(held,)], f"value array<{kind}>").scalar()
