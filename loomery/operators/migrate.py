"""Re-chunking in place: backup, parse again, replace, verify, or roll back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rechunk(chunks: DataFrame, files: DataFrame, parse: Callable[[DataFrame], DataFrame], where: str, key: str = "file_id") -> tuple[DataFrame, dict[str, int]]:
    """(chunks after, counts): the chunks of ``files`` are replaced by what ``parse`` makes of them.

    ``chunks`` is written to ``where``/backup, what is new to ``where``/fresh; nothing else is touched before it has been
    verified.  A file with text that gets no chunk, or a chunk that ends before it starts, rolls everything back to the
    backup.  ``parse`` gives rows with the columns of ``chunks``.
    """
    spark = chunks.sparkSession
    chunks.write.parquet(f"{where}/backup")
    backup = spark.read.schema(chunks.schema).parquet(f"{where}/backup")
    parse(files).select(*chunks.columns).write.parquet(f"{where}/fresh")
    fresh = spark.read.schema(chunks.schema).parquet(f"{where}/fresh")
    bare = files.filter(F.length(F.trim("text")) > 0).select(key).join(fresh.select(key).distinct(), key, "left_anti").count()
    wrong = fresh.filter(F.col("end_line") < F.col("start_line")).count()
    stats = {"files": files.count(), "before": backup.join(files.select(key), key, "left_semi").count(), "after": fresh.count(), "bare": bare, "wrong": wrong}
    if bare or wrong:
        return backup, stats | {"rolled_back": 1}
    return backup.join(files.select(key), key, "left_anti").unionByName(fresh), stats | {"rolled_back": 0}
