"""Intermediate tables in the folder that all executors share."""

from pyspark.sql import DataFrame, SparkSession

from recordloom.sources.shared import settled


def settle(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again.

    This cuts the lineage: whatever follows survives lost executors without computing `df` again.
    """
    return settled(df)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores added until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches of whole texts small in this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
