"""Which names are inside which texts, by equality: no pair is compared that doesn't match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inside(outer: DataFrame, text: str, inner: DataFrame, name: str) -> DataFrame:
    """Rows of ``outer`` with the rows of ``inner`` whose ``name``, not empty, is a substring of ``text``; each pair once.

    A text's substrings of the names' lengths, which are few, are joined on equality. Columns must not clash.
    """
    lengths = inner.select(F.length(name).alias("_n")).where("_n > 0").distinct()
    places = F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1)
    cut = outer.join(F.broadcast(lengths), F.length(text) >= F.col("_n")).select(*outer.columns, F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, F.col("_n"))))).alias("_cut"))
    return cut.join(inner, F.col("_cut") == F.col(name)).drop("_cut")
