"""Column types of a loosely typed table, inferred in one aggregate pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells


def profile(df: DataFrame) -> DataFrame:
    """(column, type, filled, numbers, dates, row_count) of each column.

    A column is a number (a currency if any cell names one) if at least 80 % of its non-blank cells are
    numbers, a date if at least 80 % are dates, else text; an empty column is text. Only the counts, one
    row, leave the executors.
    """
    read = []
    for i, f in enumerate(df.schema.fields):  # each cell is read once, in a projection below the aggregate
        c = F.col(f"`{f.name}`")
        filled = ~cells.is_blank(cells.text_of(c, f.dataType))
        if isinstance(f.dataType, T.StringType):
            cell = cells.cell(c)
            read.append(F.when(filled, F.struct(cell.alias("n"), F.when(cell.isNull(), cells.cell_date(c)).alias("d"))).alias(f"c{i}"))
        else:
            number, day = cells.cell_num(c, f.dataType), cells.cell_date(c, f.dataType)
            read.append(F.when(filled, F.struct(F.when(number.isNotNull(), F.struct(number.alias("value"), F.lit(None).cast("string").alias("currency"))).alias("n"), day.alias("d"))).alias(f"c{i}"))
    cols = df.select(*read)
    counts, plan = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"c{i}")
        counts += [F.count(c).alias(f"f{i}"), F.count(c["n"]).alias(f"n{i}"), F.count(c["n"]["currency"]).alias(f"m{i}"), F.count(c["d"]).alias(f"d{i}")]
        f_, n_, m_, d_ = (F.col(f"{k}{i}") for k in "fnmd")
        kind = F.when(f_ == 0, "text").when(n_ * 5 >= f_ * 4, F.when(m_ > 0, "currency").otherwise("number")).when(d_ * 5 >= f_ * 4, "date").otherwise("text")
        plan.append(F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), kind.alias("type"), f_.alias("filled"), n_.alias("numbers"), d_.alias("dates"), F.col("rows").alias("row_count")))
    return cols.agg(*counts).select(F.inline(F.array(*plan)))
