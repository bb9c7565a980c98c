"""File sources and sinks: binary maps, rollout arrays, manifests, traces, metric streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTITY = T.StructType(
    [
        T.StructField("source_file", T.StringType()), T.StructField("scenario_id", T.StringType()), T.StructField("sdc_track_index", T.LongType()),
        T.StructField("tracks_to_predict", T.ArrayType(T.LongType())), T.StructField("entity_idx", T.LongType()), T.StructField("is_object", T.BooleanType()),
        T.StructField("type", T.LongType()), T.StructField("id", T.LongType()),
        *[T.StructField(c, T.ArrayType(T.FloatType())) for c in ("x", "y", "z", "vx", "vy", "vz", "heading")],
        T.StructField("valid", T.ArrayType(T.IntegerType())),
        *[T.StructField(c, T.FloatType()) for c in ("width", "length", "height", "goal_x", "goal_y", "goal_z")],
        T.StructField("mark_as_expert", T.IntegerType()), T.StructField("error", T.StringType()),
    ]
)


def _decode(content: bytes) -> tuple[str, int, list[int], list[dict]]:
    """Entities of one map file; raises ValueError on truncation, negative counts or trailing bytes."""
    import numpy as np

    at = 0

    def take(n: int, dtype: str) -> np.ndarray:
        nonlocal at
        if n < 0:
            raise ValueError("negative count")
        size = n * 4
        if at + size > len(content):
            raise ValueError("truncated file")
        out = np.frombuffer(content, dtype, n, at)
        at += size
        return out

    if len(content) < 16:
        raise ValueError("truncated file")
    name = content[:16].split(b"\0")[0].decode("utf-8", "replace")
    at = 16
    sdc, n_tracks = (int(v) for v in take(2, "<i4"))
    tracks = take(n_tracks, "<i4").tolist()
    n_objects, n_roads = (int(v) for v in take(2, "<i4"))
    if n_objects < 0 or n_roads < 0:
        raise ValueError("negative count")
    rows = []
    for i in range(n_objects + n_roads):
        _, kind, ident, size = (int(v) for v in take(4, "<i4"))
        row = {"entity_idx": i, "is_object": i < n_objects, "type": kind, "id": ident}
        names = ("x", "y", "z", "vx", "vy", "vz", "heading") if kind in (1, 2, 3) else ("x", "y", "z")
        for c in names:
            row[c] = take(size, "<f4").tolist()
        if kind in (1, 2, 3):
            row["valid"] = take(size, "<i4").tolist()
        row.update(zip(("width", "length", "height", "goal_x", "goal_y", "goal_z"), take(6, "<f4").tolist()))
        row["mark_as_expert"] = int(take(1, "<i4")[0])
        rows.append(row)
    if at != len(content):
        raise ValueError("trailing bytes")
    return name, sdc, tracks, rows


def read_map_binaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, rejects) of binary map files: one row per object or road with its arrays.

    A file is the unit of decoding (it is small and has no index); files are spread over the tasks.
    """
    import pandas as pd

    columns = [f.name for f in _ENTITY.fields]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    name, sdc, tracks, rows = _decode(bytes(content))
                    out = [{"source_file": file, "scenario_id": name, "sdc_track_index": sdc, "tracks_to_predict": tracks, **r} for r in rows]
                    # A map without entities still is a scenario.
                    out = out or [{"source_file": file, "scenario_id": name, "sdc_track_index": sdc, "tracks_to_predict": tracks}]
                except ValueError as e:
                    out = [{"source_file": file, "error": str(e)}]
                yield pd.DataFrame(out).reindex(columns=columns).astype(object).where(lambda d: d.notna(), None)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", True).load(path)
    decoded = raw.select("path", "content").mapInPandas(decode, _ENTITY)
    return decoded.filter("error is null").drop("error"), decoded.filter("error is not null").select("source_file", "error")


def explode_rollouts(imported: DataFrame, cols: list[str] = ["x", "y", "z", "heading"]) -> DataFrame:
    """Imported trajectories, per agent arrays of rollouts of steps, to the long state table."""
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    a = imported.select("scenario_id", "agent_id", F.posexplode(zipped).alias("rollout", "_r"))
    b = a.select("scenario_id", "agent_id", "rollout", F.posexplode(F.arrays_zip(*[F.col("_r")[c].alias(c) for c in cols])).alias("step", "_s"))
    return b.select("scenario_id", "agent_id", F.col("rollout").cast("long").alias("rollout"), F.col("step").cast("long").alias("step"), *[F.col("_s")[c].alias(c) for c in cols])


MANIFEST = T.StructType(
    [
        T.StructField("file", T.StringType()), T.StructField("processed_file", T.StringType()), T.StructField("segment_id", T.StringType()),
        T.StructField("timestamp_micros", T.LongType()), T.StructField("schema_version", T.IntegerType()),
    ]
)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_manifest(entries: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, one per sample, written by all tasks; rewriting only touches the partitions present."""
    writer = entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(by) if by else writer).json(path)


def manifest_summary(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("num_samples"), F.countDistinct("segment_id").alias("num_segments"))


def split_identity(file: DataFrame, name: str = "file") -> DataFrame:
    """segment_id and timestamp_micros from ``segment__timestamp.ext`` names."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return file.withColumns({"segment_id": F.regexp_extract(stem, r"^(.*)__(\d+)$", 1), "timestamp_micros": F.regexp_extract(stem, r"^(.*)__(\d+)$", 2).cast("long")})


def write_trace_csv(trace: DataFrame, path: str) -> None:
    trace.write.mode("overwrite").option("header", True).csv(path)


def flatten_metrics(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs to ``a/b`` columns; leaves that are not numeric are dropped.  String-keyed maps are left to ``unpivot_map``."""
    out = []

    def walk(schema: T.StructType, path: list[str]) -> None:
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
                out.append(F.col(".".join(f"`{p}`" for p in here)).cast("double").alias(sep.join(here)))

    walk(df.schema, [])
    return df.select(*out)


def long_metrics(flat: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, key, value) from flattened metric columns."""
    values = [c for c in flat.columns if c not in ids]
    return flat.select(*[F.col(f"`{c}`") for c in flat.columns]).unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], "key", "value")


def read_metric_stream(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Append-only JSON-lines directory as a stream."""
    return spark.readStream.schema(schema).json(path)


def write_append_stream(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
