"""Scans (survey S1-S16, S22). Schemas are given, never inferred from data."""

from __future__ import annotations

import io
import json
import os
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _ddl(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: str | T.StructType, keep: int = 500) -> DataFrame:
    """Bad lines become rows with _parse_error true and their first characters in _raw (all other columns null). Blank lines are skipped."""
    s = T.StructType([*_ddl(schema).fields, T.StructField(CORRUPT, T.StringType())])
    x = spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return x.withColumns({"_parse_error": F.col(CORRUPT).isNotNull(), "_raw": F.substring(CORRUPT, 1, keep)}).drop(CORRUPT)


def jsonl_strict(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """The first bad line fails the job."""
    return spark.read.schema(_ddl(schema)).option("mode", "FAILFAST").json(path)


def jsonl_skipping(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Bad lines are dropped silently."""
    return spark.read.schema(_ddl(schema)).option("mode", "DROPMALFORMED").json(path)


def jsonl_limited(spark: SparkSession, specs: list[str], schema: str | T.StructType) -> DataFrame:
    """S3: 'file:N' specs, the first N rows of each in file order; adds source_file. A spec without N takes all rows."""
    out = None
    for spec in specs:
        path, sep, n = spec.rpartition(":")
        path, limit = (path, int(n)) if sep and n.isdigit() else (spec, None)
        x = spark.read.schema(_ddl(schema)).json(path).withColumn("source_file", F.col("_metadata.file_name"))
        x = x.limit(limit) if limit is not None else x
        out = x if out is None else out.unionByName(x)
    return out if out is not None else spark.createDataFrame([], T.StructType([*_ddl(schema).fields, T.StructField("source_file", T.StringType())]))


def chunks(spark: SparkSession, folder: str, schema: str | T.StructType, glob: str = "chunk_*.jsonl") -> DataFrame:
    """Every chunk up to its first bad line; the rest of that file is abandoned. Adds source_file.

    The first bad offset of a file is a small aggregate (one row per bad file) joined back by file.
    """
    s = T.StructType([*_ddl(schema).fields, T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.option("wholetext", "false").text(os.path.join(folder, glob)).select("value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"))
    x = raw.where("trim(value) != ''").withColumn("r", F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = x.where(F.col(f"r.{CORRUPT}").isNotNull()).groupBy("source_file").agg(F.min(F.struct("block", "no")).alias("first_bad"))
    x = x.join(bad, "source_file", "left").where(F.col("first_bad").isNull() | (F.struct("block", "no") < F.col("first_bad")))
    return x.select(*(F.col(f"r.{f.name}").alias(f.name) for f in _ddl(schema).fields), "source_file")


def json_folder(spark: SparkSession, folder: str, schema: str | T.StructType, exclude: tuple[str, ...] = ("_traces", "exampler_cache")) -> DataFrame:
    """*.json files of arrays, without names that have an excluded part or start with a dot; files that hold no list give nothing."""
    x = spark.read.schema(_ddl(schema)).option("multiLine", True).option("mode", "DROPMALFORMED").json(os.path.join(folder, "*.json")).withColumn("source_file", F.col("_metadata.file_name"))
    ok = ~F.col("source_file").startswith(".")
    for e in exclude:
        ok = ok & ~F.col("source_file").contains(e)
    whole = spark.read.option("wholetext", True).text(os.path.join(folder, "*.json")).select(F.col("_metadata.file_name").alias("source_file"), F.ltrim("value").startswith("[").alias("is_list"))
    return x.where(ok).join(whole.where("is_list"), "source_file", "left_semi").select(x.columns)


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A file that is one list; anything else is an error."""
    return spark.read.schema(_ddl(schema)).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_object(spark: SparkSession, path: str, value_schema: str | T.StructType, key: str = "id") -> DataFrame:
    """An object of objects; each key becomes a column. One file is one row, since its format cannot be split."""
    kind = T.MapType(T.StringType(), _ddl(value_schema))
    x = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", kind)).alias(key, "v"))
    return x.select(key, "v.*")


def task_items(spark: SparkSession, path: str, schema: str | T.StructType, kind: str | None = None) -> DataFrame:
    """By kind or ending: jsonl, json, or a folder of jsonl."""
    kind = kind or ("folder" if os.path.isdir(path) else "jsonl" if path.endswith(".jsonl") else "json")
    if kind == "jsonl":
        return jsonl_skipping(spark, path, schema)
    if kind == "json":
        return json_array(spark, path, schema)
    if kind == "folder":
        return jsonl_skipping(spark, os.path.join(path, "*.jsonl"), schema)
    raise ValueError(f"unknown dataset type {kind}")


def gzip_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: list[str] | None = None, partitions: int | None = None, dates: dict[str, str] | None = None) -> DataFrame:
    """Typed, pruned; dates: column -> pattern, invalid dates are null. A gzip file is one split, so rows are spread if asked."""
    x = spark.read.schema(_ddl(schema)).option("header", True).csv(path)
    x = x.select(*columns) if columns else x
    for c, p in (dates or {}).items():
        x = x.withColumn(c, F.try_to_timestamp(F.col(c).cast("string"), F.lit(p)).cast("date"))
    return x.repartition(partitions) if partitions else x


def tsv_images(spark: SparkSession, path: str, schema: str | T.StructType, image: str = "image") -> DataFrame:
    """Tab-separated with a base64 column, which becomes binary."""
    return spark.read.schema(_ddl(schema)).option("header", True).option("sep", "\t").csv(path).withColumn(image, F.unbase64(image))


def parquet_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """S12: '{split}-*.parquet' with the split as column; a missing split is an error (of the reader)."""
    return spark.read.parquet(os.path.join(folder, f"{split}-*.parquet")).withColumn("split", F.lit(split))


def scenarios(spark: SparkSession, path: str, schema: str | T.StructType, body: str | None = None) -> DataFrame:
    """Scenario lines; with `body`, rows without one (failed conversions) are dropped."""
    x = jsonl_skipping(spark, path, schema)
    return x.where(F.col(body).isNotNull()) if body else x


def tar_samples(spark: SparkSession, path: str) -> DataFrame:
    """(shard, key, json, image): members of tar shards joined by their base name. A shard is read by one task."""

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"]):
                got: dict[str, dict] = {}
                with tarfile.open(fileobj=io.BytesIO(content)) as t:
                    for m in t.getmembers():
                        if m.isfile():
                            key, _, ext = m.name.rpartition(".")
                            data = t.extractfile(m).read()
                            got.setdefault(key, {})["json" if ext == "json" else "image"] = data.decode() if ext == "json" else data
                yield pd.DataFrame([(os.path.basename(name), k, v.get("json"), v.get("image")) for k, v in got.items()], columns=["shard", "key", "json", "image"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "shard string, key string, json string, image binary")


def prompt_sections(text: str) -> dict[str, str]:
    """S16: '[NAME]' headers to their text; a later section of the same name wins. Configuration, so it stays on the driver."""
    out: dict[str, list[str]] = {}
    name = None
    for line in text.splitlines():
        s = line.strip()
        if len(s) > 2 and s[0] == "[" and s[-1] == "]" and " " not in s:
            name = s[1:-1]
            out[name] = []
        elif name is not None:
            out[name].append(line)
    return {k: "\n".join(v).strip() for k, v in out.items()}


def keyed_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, key: str) -> DataFrame:
    """Rows for joins by key, sorted within partitions by key."""
    return jsonl_strict(spark, path, schema).repartition(key).sortWithinPartitions(key)


def tool_manifest(data: str, exclude: tuple[str, ...] = ()) -> str:
    """A manifest's tools as the JSON text of a training row: the internal thought parameter removed, excluded
    tools and those with an array schema without items left out (F24). Configuration, so it stays on the driver."""
    from ..functions.lenient import bad_schema

    out = []
    for t in json.loads(data).get("tools", []):
        name, schema = (t.get("name") or "").strip(), dict(t.get("args_schema") or {})
        if not name or name in exclude:
            continue
        props = {k: v for k, v in (schema.get("properties") or {}).items() if k != "thought"}
        if bad_schema(json.dumps({"properties": props})):
            continue
        params = {"type": schema.get("type", "object"), "properties": props}
        if "required" in schema:
            params["required"] = [r for r in schema["required"] if r != "thought"]
        out.append({"name": name, "description": (t.get("description") or "").strip(), "parameters": params})
    return json.dumps(out, ensure_ascii=False)
