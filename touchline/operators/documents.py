"""JSON documents as ordered lines.

A document may hold any number of rows, so it is never built as one string:
it is a sorted table of text lines. Written as text, the part files in name
order are the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.ordered import carried_forward, ordered

OPEN, ROW, CLOSE = 0, 1, 2
LINE_ORDER = ["table", "part"]


def document_lines(
    rows: DataFrame,
    keys: Sequence[str],
    tables: Sequence[str],
    order_by: Sequence[str],
    value: Column | str = "value",
    places: DataFrame | None = None,
) -> DataFrame:
    """One JSON object per key, with one array per table name; no rows give ``[]``.

    ``rows`` has the keys, ``table`` (index into ``tables``), the ordering columns
    and ``value`` (a row as JSON text). Sort the result by keys, ``table``,
    ``part`` and ``order_by``. A ``value`` given as an expression over ``rows`` is
    built after the join, which then moves its columns instead of the text. ``places``: the keys, ``table``
    and ordering columns of the same rows, where they are had without building ``rows``.
    """
    place = F.struct(*order_by)
    listed = rows if places is None else places
    first = listed.groupBy(*keys, "table").agg(F.min(place).alias("_first"))
    comma = F.when(place.eqNullSafe(F.col("_first")), "").otherwise(",")
    body = rows.join(first, [*keys, "table"]).select(
        *keys, "table", F.lit(ROW).alias("part"), *order_by, F.concat(comma, value).alias("value")
    )
    frame = []
    for index, name in enumerate(tables):
        head = "{" if index == 0 else ""
        tail = "}" if index == len(tables) - 1 else ","
        frame += [(index, OPEN, f'{head}"{name}": ['), (index, CLOSE, f"]{tail}")]
    lines = F.array(
        *[
            F.struct(F.lit(t).alias("table"), F.lit(p).alias("part"), F.lit(v).alias("value"))
            for t, p, v in frame
        ]
    )
    outline = first.select(*keys).distinct().select(*keys, F.inline(lines))
    return body.unionByName(outline, allowMissingColumns=True)


def write_document(
    lines: DataFrame, keys: Sequence[str], order_by: Sequence[str], path: str
) -> None:
    """Write the lines of one document (or several, one after the other) as text."""
    in_order = lines.orderBy(*keys, *LINE_ORDER, *order_by)
    in_order.select("value").write.mode("overwrite").text(path)


def write_documents(
    lines: DataFrame, key: str, order_by: Sequence[str], path: str, slices: int | None = None
) -> None:
    """Write all documents in one job, each into a folder ``key=value`` of its own.

    The lines are cut into contiguous ranges of their whole order, so a task holds a
    slice of one or more documents, never all of a large one. The part files of a folder, in
    name order, are its document. ``slices`` is the number of ranges (by default the
    session's shuffle partitions). Older output is replaced.
    """
    order = [F.col(c) for c in (key, *LINE_ORDER, *order_by)]
    number = [] if slices is None else [slices]
    sliced = lines.repartitionByRange(*number, *order).sortWithinPartitions(*order)
    sliced.select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def read_documents(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of documents that ``write_documents`` wrote: ``key``, ``table``, ``value``.

    ``table`` is the name of the array that a row stands in, taken from the last opening line
    before it; ``value`` is the row as JSON text. No document is put together in a task. Runs jobs.
    """
    read = spark.read.text(path).select(
        key, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"), "value",
    )
    placed = ordered(read, F.col(key), F.col("_file"), F.col("_start"), F.col("_line"))
    opening = F.regexp_extract("value", r'^\{?"([^"]*)": \[$', 1)
    named = carried_forward(placed, F.when(opening != "", opening), "table")
    rows = named.filter((opening == "") & ~F.col("value").isin("],", "]}"))
    return rows.select(key, "table", F.regexp_replace("value", "^,", "").alias("value"))
