"""Sinks (survey S17-S21). Spark's committer replaces file locks: partial output of a failed task is never seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, text not escaped to ASCII; mode append adds files, so finished items stay."""
    df.write.mode(mode).json(path)


def write_by_type(df: DataFrame, path: str, column: str = "sft_type") -> None:
    """One folder per type in one pass."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def merge_folders(spark, paths: list[str], schema: str) -> DataFrame:
    """All rows of several output folders."""
    return spark.read.schema(schema).json(paths)


def write_images_once(df: DataFrame, content: str, folder: str, ext: str = "jpg") -> DataFrame:
    """Writes every distinct content once under its md5's first 16 hex digits; returns (h, path).

    Contents are reduced to one per hash before writing. `folder` must be shared by all executors. Writing to a
    temporary name and renaming makes a repeated task harmless.
    """

    def save(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for pdf in it:
            paths = []
            for h, data in zip(pdf["h"], pdf["content"]):
                path = os.path.join(folder, f"{h}.{ext}")
                if not os.path.exists(path):
                    part = f"{path}.{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, path)
                paths.append(path)
            yield pd.DataFrame({"h": pdf["h"], "path": paths})

    x = df.where(F.col(content).isNotNull()).select(F.substring(F.md5(content), 1, 16).alias("h"), F.col(content).alias("content")).dropDuplicates(["h"])
    return x.mapInPandas(save, "h string, path string")
