"""Reading and publishing: a new version's data first, its manifest last, so that readers never meet half of it."""

from __future__ import annotations

import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "space-2"


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def removed(spark: SparkSession, folder: str) -> None:
    files, path = _files(spark, folder)
    files.delete(path, True)


def _release(manifest: DataFrame, folder: str, version: str) -> None:
    """Write the manifest of a version, whose data must be there."""
    manifest.coalesce(1).write.parquet(f"{folder}/manifests/{version}")


def _version() -> str:
    """Names of versions sort by the time they were begun."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def newest(spark: SparkSession, folder: str) -> str:
    """The version whose manifest was written last and whole."""
    files, path = _files(spark, f"{folder}/manifests/*/_SUCCESS")
    found = [s.getPath().getParent().getName() for s in files.globStatus(path) or []]
    if not found:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return max(found)


def replace(rows: DataFrame, folder: str) -> None:
    """Publish a whole new state of a table; readers meet the former one until it is there."""
    spark, version = rows.sparkSession, _version()
    rows.write.parquet(f"{folder}/versions/{version}/rows")
    n = spark.read.parquet(f"{folder}/versions/{version}/rows").count()
    _release(spark.createDataFrame([(n,)], "n long"), folder, version)


def current(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/versions/{newest(spark, folder)}/rows")


def publish(space: DataFrame, folder: str, blocks: list[tuple[str, int, int, float]], mean: np.ndarray | None = None, axes: np.ndarray | None = None) -> None:
    """Write a space, and the axes of its semantic block where given, then its manifest."""
    spark, version = space.sparkSession, _version()
    at = f"{folder}/versions/{version}"
    space.write.parquet(f"{at}/rows")
    if mean is not None and axes is not None:
        rows = [(-1, mean.tolist()), *((i, a.tolist()) for i, a in enumerate(axes))]
        spark.createDataFrame(rows, "axis int, v array<double>").coalesce(1).write.parquet(f"{at}/params")
    n = spark.read.parquet(f"{at}/rows").count()
    manifest = [(VERSION, n, max(b[2] for b in blocks), [(b[0], b[1], b[2], float(b[3])) for b in blocks], len(mean) if mean is not None else 0, len(axes) if axes is not None else 0)]
    schema = "version string, n_tracks long, n_dims int, blocks array<struct<name: string, start: int, end: int, weight: double>>, input_dim int, n_components int"
    _release(spark.createDataFrame(manifest, schema), folder, version)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The space published last; fails if the manifest doesn't describe its rows."""
    version = newest(spark, folder)
    manifest, rows = spark.read.parquet(f"{folder}/manifests/{version}").head(), spark.read.parquet(f"{folder}/versions/{version}/rows")
    if manifest["version"] != VERSION:
        raise ValueError(f"this space is of version {manifest['version']}, not {VERSION}")
    ends = [0, *(b["end"] for b in manifest["blocks"])]
    if [b["start"] for b in manifest["blocks"]] != ends[:-1] or ends[-1] != manifest["n_dims"]:
        raise ValueError("the blocks don't cover the dimensions in order")
    checked = rows.agg(F.count("*").alias("n"), F.sum((F.size("vec") != manifest["n_dims"]).cast("int")).alias("odd")).head()
    if checked["n"] != manifest["n_tracks"] or checked["odd"]:
        raise ValueError("the rows don't fit the manifest")
    return rows


def load_params(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes of the space published last; fails if they aren't as the manifest says."""
    version = newest(spark, folder)
    manifest = spark.read.parquet(f"{folder}/manifests/{version}").head()
    if not manifest["input_dim"]:
        raise ValueError("this space has no axes")
    rows = [r["v"] for r in spark.read.parquet(f"{folder}/versions/{version}/params").orderBy("axis").collect()]  # one row an axis
    if len(rows) != manifest["n_components"] + 1 or any(len(r) != manifest["input_dim"] for r in rows):
        raise ValueError("the axes don't fit the manifest")
    return np.array(rows[0]), np.array(rows[1:]).reshape(-1, manifest["input_dim"])


def matrix(ids: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(row_idx, track_id, vec) for each id; zeros where there is no vector or one of another width."""
    met = ids.join(vectors.select("track_id", "vec"), "track_id", "left")
    return met.withColumn("vec", F.when(F.size("vec") == width, F.col("vec").cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), width)))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, md5) of the files of a folder, read by the executors."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("md5"))


def to_send(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Names of files that the other side lacks or has with another digest."""
    return local.join(remote, ["name", "md5"], "left_anti").select("name")


def in_order(ids: DataFrame, rows: DataFrame, defaults: dict) -> DataFrame:
    """Rows in the ids' order (row_idx); an id without a row gets the title `<missing id>` and defaults."""
    met = ids.join(rows.withColumn("known", F.lit(True)), "track_id", "left")
    met = met.withColumn("title", F.when(F.col("known"), F.col("title")).otherwise(F.concat(F.lit("<missing "), F.col("track_id").cast("string"), F.lit(">"))))
    return met.withColumns({c: F.when(F.col("known"), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()}).drop("known")


#: The tables and columns of a slim catalogue.
SLIM = {
    "artists": ["id", "name"],
    "albums": ["id", "artist_id", "title", "release_date", "label", "genre"],
    "tracks": ["id", "album_id", "artist_id", "title", "duration", "isrc", "seed_distance"],
    "layout": ["track_id", "x", "y"],
    "blocked_artists": ["artist_id", "name", "reason", "blocked_at"],
    "features": ["track_id", "extractor_version", "descriptors_json", "clap_f32", "analysed_at"],
}


def only_field(json: Column, field: str) -> Column:
    """A JSON text with one numeric field alone, null where it isn't a number; a null text stays null."""
    number = F.get_json_object(json, f"$.{field}").try_cast("double").alias(field)
    return F.when(json.isNotNull(), F.to_json(F.struct(number), {"ignoreNullFields": "false"}))


def slim(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without payloads, and descriptors with their tempo alone."""
    kept = {name: tables[name].select(*columns) for name, columns in SLIM.items() if name in tables}
    if "features" in kept:
        kept["features"] = kept["features"].withColumn("descriptors_json", only_field(F.col("descriptors_json"), "bpm"))
    return kept


def publish_catalogue(tables: dict[str, DataFrame], folder: str) -> None:
    """Write a slim catalogue: its tables, then a manifest of their rows that readers wait for."""
    counts, version = [], _version()
    for name, df in slim(tables).items():
        df.write.parquet(f"{folder}/versions/{version}/{name}")
        counts.append((name, df.sparkSession.read.parquet(f"{folder}/versions/{version}/{name}").count()))
    if counts:
        spark = next(iter(tables.values())).sparkSession
        _release(spark.createDataFrame(counts, "name string, n long"), folder, version)
