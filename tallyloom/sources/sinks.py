"""What rows become on their way out: the frame of 19 columns, JSON records, CSV, and the stored rows of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EMPTY, FRAME


def frame(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows as the frame's columns, with their types; columns that rows lack hold what means "not given"."""
    have = set(rows.columns)
    cols = [(F.col(c) if c in have else F.lit(EMPTY.get(c))).cast(t).alias(c) for c, t in FRAME.items()]
    return rows.select(*[k for k in keys if k in have], *cols)


def transported(c: str, kind: str) -> Column:
    """Money and dates as text, all else as it is."""
    return F.col(c).cast("string").alias(c) if kind.startswith("decimal") or kind == "date" else F.col(c)


def job_rows(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """job_id, idx (from 0 in the order of the rows) and payload: a JSON record in which no field is left out."""
    kinds = dict(rows.dtypes)
    cols = columns or [c for c in FRAME if c in kinds]
    idx = F.row_number().over(Window.partitionBy("job_id").orderBy("page_no", "source_row")) - 1
    return rows.select("job_id", idx.alias("idx"), F.to_json(F.struct(*[transported(c, kinds[c]) for c in cols]), {"ignoreNullFields": "false"}).alias("payload"))


def replace_job_rows(stored: DataFrame, path: str) -> None:
    """Stores the rows of these jobs in place of those that they had, and leaves other jobs alone."""
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    frame(rows).write.mode("overwrite").csv(path, header=True)


def append(entries: DataFrame, path: str) -> None:
    """Audit entries and events are only ever added."""
    entries.write.mode("append").parquet(path)
