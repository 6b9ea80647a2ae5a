"""Readers and writers: CSV, GeoJSON, layers of a dataset, checked columns."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType
from pyspark.sql.utils import AnalysisException

from ..functions.geometry import GEOMETRY, to_wkt
from ..functions.text import after_token, zero_padded


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The part of the shared folder that scratch() has opened here, if any.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir (or a part of it, within scratch()), or in local mode a new local one."""
    folder = _SCRATCH.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="terradelta-"))
    return folder.rstrip("/")


#: The local folder of each application in local mode.
_LOCAL: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A part of the shared folder for what queries write on their way; it and all in it go at the end, so collect or write results inside.

        with scratch(spark):
            query(spark, folder).write.parquet(path)
    """
    path = new_path(spark, "scratch")
    before = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(before)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """df, written once to the folder that driver and executors share (spark.checkpoint.dir; on one machine a new local one) and read again.

    For what several later steps use: it is worked out once, and a lost executor costs no more than a read.
    """
    path = new_path(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merging(df: DataFrame) -> DataFrame:
    """df as one side of a sort-merge join.

    For what grows with the data: Spark takes a table's size from that of its compressed files, and that of what explode makes of it from the table, so
    it would gather millions of rows in the driver to broadcast them.
    """
    return df.hint("merge")


def dealt(df: DataFrame, key: str = "id") -> DataFrame:
    """df dealt out to all cores, for much work on few bytes: a small file would give its rows to a task or two, and tasks of few bytes are joined to large ones."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """With a header and quoted fields that may hold line breaks and commas."""
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)


def optional_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """None where there is no such file."""
    try:
        return csv(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A row for each feature with its properties (a DDL string) and geometry; features that aren't polygons have a null geometry."""
    shape = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    read = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    one = F.transform(F.from_json(text, "array<array<array<double>>>"), lambda r: F.transform(r, point))
    many = F.transform(F.from_json(text, "array<array<array<array<double>>>>"), lambda p: F.transform(p, lambda r: F.transform(r, point)))
    return read.select("f.properties.*", F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many).cast(GEOMETRY).alias("geometry"))


def write_geojson(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """One feature a line."""
    pair = lambda p: F.array(p["x"], p["y"])
    coordinates = F.transform(geometry, lambda p: F.transform(p, lambda r: F.transform(r, pair)))
    rest = F.struct(*(c for c in df.columns if c != geometry))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), rest.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias("geometry")))).write.mode("overwrite").text(path)


def geojson_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """What write_geojson wrote: a row for each feature with its properties (a DDL string) and geometry."""
    fields = ",".join(":".join(f.split()) for f in properties.split(","))
    read = spark.read.schema(f"properties struct<{fields}>, geometry struct<coordinates:array<array<array<array<double>>>>>").json(path)
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return read.select("properties.*", F.transform("geometry.coordinates", lambda p: F.transform(p, lambda r: F.transform(r, point))).alias("geometry"))


def layer(spark: SparkSession, path: str, preferred: str) -> DataFrame:
    """The preferred layer of a dataset written by write_layers, else its first."""
    layers = spark.read.parquet(path)
    names = sorted(r[0] for r in layers.select("layer").distinct().collect())  # a handful
    return layers.where(F.col("layer") == (preferred if preferred in names else names[0])).drop("layer")


def write_layers(path: str, layers: dict[str, DataFrame]) -> list[str]:
    """Each layer that has rows, as a partition; the names written. What was there before goes."""
    kept = {k: v for k, v in layers.items() if not v.isEmpty()}
    for i, (name, df) in enumerate(kept.items()):
        df.withColumn("layer", F.lit(name)).write.mode("append" if i else "overwrite").partitionBy("layer").parquet(path)
    return list(kept)


def write_csv(df: DataFrame, path: str, geometry: str | None = "geometry", keep_wkt: bool = False) -> None:
    """Without the geometry, or with its text; quotes in a field are doubled, as csv() reads them."""
    if geometry in df.columns:
        df = df.withColumn(geometry, to_wkt(F.col(geometry))) if keep_wkt else df.drop(geometry)
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def config(path: str) -> dict:
    return json.loads(Path(path).read_text())


def require_columns(df: DataFrame, names: set[str]) -> DataFrame:
    if missing := names - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df


def with_optional(df: DataFrame, name: str, kind: DataType | str) -> DataFrame:
    """df with a typed null column where it has none of that name."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def existing(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the columns that df has, in this order."""
    return df.select(*(n for n in names if n in df.columns))


def buildings(df: DataFrame, geometry: str = "geometry", kind: str | None = None) -> DataFrame:
    """Rows with a polygon: a geometry that isn't null, of a type (column `kind`, if there is one) of polygons."""
    kept = df.where(F.col(geometry).isNotNull())
    return kept if kind is None else kept.where(F.col(kind).isin("Polygon", "MultiPolygon"))


def in_first_folder(ids: DataFrame, listing: DataFrame, folders: list[str], ending: str = ".png") -> DataFrame:
    """id and path of each id's file (0007.png for 7) in the first of the folders that has it; ids without one are left out. listing: column path."""
    rank = F.array_position(F.array(*map(F.lit, folders)), F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    files = listing.withColumn("rank", rank).where("rank > 0").withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    wanted = ids.select("id", F.concat(zero_padded(F.col("id"), 4), F.lit(ending)).alias("name"))
    return wanted.join(files, "name").groupBy("id").agg(F.min_by("path", "rank").alias("path"))


def resolved(paths: DataFrame, listing: DataFrame, root: str, tokens: list[str]) -> DataFrame:
    """id and path, the first that exists of: as it is, below the root, below the root from behind a token; null if none does. listing: column path."""
    tried = F.array(F.struct(F.lit(0).alias("k"), F.col("path").alias("p")), F.struct(F.lit(1).alias("k"), F.concat(F.lit(root + "/"), F.when(~F.col("path").startswith("/"), F.col("path"))).alias("p")), F.struct(F.lit(2).alias("k"), F.concat(F.lit(root + "/"), after_token(F.col("path"), tokens)).alias("p")))
    each = paths.select("id", F.explode(tried).alias("t")).select("id", "t.*").where("p is not null")
    found = each.join(listing.select(F.col("path").alias("p")).distinct(), "p").groupBy("id").agg(F.min_by("p", "k").alias("resolved"))
    return paths.select("id").join(found, "id", "left").select("id", F.col("resolved").alias("path"))


def write_snapshots(df: DataFrame, date: str = "snapshot_date") -> str:
    """States of objects, a partition for each snapshot's date; the path."""
    path = new_path(df.sparkSession, "snapshots")
    df.repartition(F.col(date)).write.partitionBy(date).parquet(path)
    return path


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_of(df: DataFrame, key: str, tie: str, day: str, date: str = "snapshot_date") -> DataFrame:
    """The latest state of each object up to a day: partitions of later dates aren't read; of several states of one date the greatest `tie`."""
    rest = [k for k in df.columns if k != key]
    latest = df.where(F.col(date) <= F.lit(day).cast("date")).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(date, tie)).alias("_last"))
    return latest.select(key, *(F.col(f"_last.{k}").alias(k) for k in rest))


def csv_or_rows(spark: SparkSession, path: str, schema: StructType | str, rows: list[tuple]) -> DataFrame:
    """The file, or the rows of a config where there is none."""
    found = optional_csv(spark, path, schema)
    return spark.createDataFrame(rows, schema) if found is None else found


def write_with_config(df: DataFrame, path: str, settings: dict) -> None:
    """The table as Parquet and, beside it, the settings that made it as JSON text."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
