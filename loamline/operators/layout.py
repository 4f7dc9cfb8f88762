"""Reading order of page layout blocks, and tables as text, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.scalar import reflow

PAGE = ["document_id", "page_number"]
#: Share of a block's area within a figure beyond which it belongs to the figure; how many times the usual gap parts columns.
OVERLAP, COLUMN_GAP = 0.25, 1.5


def outside_figures(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """Blocks of which no figure of their page covers more than OVERLAP. blocks and figures: document_id, page_number, x0, y0, x1, y1."""
    a, b = blocks.alias("a"), figures.alias("b")
    width = F.greatest(F.lit(0.0), F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0"))
    height = F.greatest(F.lit(0.0), F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0"))
    area = F.greatest(F.lit(1.0), (F.col("a.x1") - F.col("a.x0")) * (F.col("a.y1") - F.col("a.y0")))
    same = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.page_number") == F.col("b.page_number"))
    return a.join(b, same & (width * height / area > OVERLAP), "left_anti")


def _last(*names: str) -> list[Column]:
    """Ascending, nulls last."""
    return [F.asc_nulls_last(n) for n in names]


def gap_before(rows: DataFrame, group: str | list[str], order: list[str], value: str) -> DataFrame:
    """rows with `gap`: from the value of the row before to this one's; null for the first. In order nulls come last."""
    along = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*_last(*order))
    return rows.withColumn("gap", F.col(value) - F.lag(value).over(along))


def reading_order(blocks: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """blocks with `column` and `place`. Columns part where the gap between neighbouring centres is over 1.5 times the upper median gap (the greatest gap, if that is 0); within a column blocks go by y. Blocks without a centre or y come last. ties: columns that order blocks of one y, centre and number; without them such blocks come as the exchange brings them."""
    page = Window.partitionBy(*PAGE)
    across = page.orderBy(*_last("centre", "block"))
    out = gap_before(blocks.withColumn("centre", (F.col("x0") + F.col("x1")) / 2.0), PAGE, ["centre", "block"], "centre")
    gaps = F.array_sort(F.collect_list("gap").over(page))  # of one page
    median = F.coalesce(F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")), F.lit(0.0))
    usual = F.when(median == 0, F.coalesce(F.array_max(gaps), F.lit(0.0))).otherwise(median)
    out = out.withColumn("parts", F.coalesce((F.col("gap") > COLUMN_GAP * usual).cast("int"), F.lit(0)))
    out = out.withColumn("column", F.sum("parts").over(across))
    return out.withColumn("place", F.row_number().over(page.orderBy(*_last("column", "y0", "centre", "block", *ties)))).drop("gap", "parts")


def page_text(blocks: DataFrame, figures: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, page_number, text): the flowing text of each page that has any block outside its figures; null if none of them has a text. ties: see reading_order()."""
    ordered = reading_order(outside_figures(blocks, figures), ties)
    texts = F.array_sort(F.collect_list(F.struct("place", "text")))
    text = reflow(F.array_join(F.transform(texts, lambda t: t["text"]), "\n\n"))
    return ordered.groupBy(*PAGE).agg(F.when(F.count("text") > 0, text).alias("text"))


def table_text(rows: Column) -> Column:
    """A table (array of rows of cells) as tab-separated lines; a null cell is empty."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t")), "\n")
