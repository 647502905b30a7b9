"""Documents as lines and back. Both sides keep the document as the only shuffle key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line); a null text has no lines, an empty one a single empty line."""
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def upto(*keys: str, order: str = "line_no") -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def joined(value: str, order: str, sep: str = "\n") -> F.Column:
    """Aggregate: the values joined in their order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda x: x[value]), sep)
