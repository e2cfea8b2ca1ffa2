"""Scans and sinks: image folders, index files, id lists, JSON, feature tables and logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions import names


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name) of the files right under a folder whose names match a glob. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def index_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, label) of lines ``path label``."""
    return parse_index(spark.read.text(path))


def parse_index(lines: DataFrame) -> DataFrame:
    part = F.split(F.trim("value"), " ")
    return lines.where(F.trim("value") != "").select(part[0].alias("path"), part[1].cast("int").alias("label"))


def parse_id_list(lines: DataFrame) -> DataFrame:
    """(id, name) of comma-separated numbers: the number and its four-digit folder name."""
    each = lines.select(F.explode(F.split("value", ",")).alias("n")).where("trim(n) <> ''")
    return each.select(F.trim("n").cast("int").alias("id")).where("id is not null").withColumn("name", F.lpad(F.col("id").cast("string"), 4, "0"))


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_features(df: DataFrame, path: str) -> None:
    """Feature tables (checkpoints, query and gallery dumps) are Parquet, by split if there is a column of that name."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("split") if "split" in df.columns else writer).parquet(path)


@dataclass(frozen=True)
class Collection:
    """How a collection names its files: parser, glob, and the bounds that its ids keep."""

    parse: Callable
    pattern: str
    cameras: tuple[int, int]
    max_pid: int | None = None
    camera_map: dict[int, int] | None = None


#: Cameras and identities of the known collections.
COLLECTIONS = {
    "market1501": Collection(names.market, "*.jpg", (1, 6), 1501),
    "msmt17": Collection(names.underscore, "*.jpg", (1, 15)),
    "dukemtmc": Collection(names.underscore, "*.jpg", (1, 8)),
    "sysu_all": Collection(names.market, "*.jpg", (1, 6)),
    "sysu_ir": Collection(names.market, "*.jpg", (1, 6)),
    "sysu_rgb": Collection(names.market, "*.jpg", (1, 6)),
    "regdb_ir": Collection(names.market, "*.bmp", (1, 2)),
    "regdb_rgb": Collection(names.market, "*.bmp", (1, 2)),
    "llcm_ir": Collection(names.market, "*.jpg", (1, 9), None, {1: 0, 2: 1, 4: 2, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7}),
    "llcm_rgb": Collection(names.market, "*.jpg", (1, 9), None, {c: c - 1 for c in range(1, 10)}),
}


def collection_names() -> list[str]:
    return sorted(COLLECTIONS)


def create(spark: SparkSession, name: str, root: str, splits: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The splits of a collection as catalogs (path, pid, cam); only the training split is relabelled."""
    if name not in COLLECTIONS:
        raise KeyError(f"Unknown collection: {name}")
    splits = splits or {"train": "bounding_box_train", "query": "query", "gallery": "bounding_box_test"}
    return {s: catalog(list_files(spark, f"{root}/{folder}", COLLECTIONS[name].pattern), COLLECTIONS[name], relabel=s == "train") for s, folder in splits.items()}


def catalog(files: DataFrame, of: Collection, relabel: bool = False) -> DataFrame:
    """``files`` (.., name) with pid and 0-based cam: junk (pid -1) dropped, bounds asserted, pids ranked if asked for."""
    from vicinity.operators.labels import dense_label

    pid, cam = of.parse(F.col("name"))
    rows = files.withColumn("pid", pid).withColumn("cam", cam).where("pid <> -1")
    low, high = of.cameras
    ok = F.col("cam").between(low, high) & (F.col("pid") >= 0)
    if of.max_pid is not None:
        ok &= F.col("pid") <= of.max_pid
    rows = rows.withColumn("cam", F.when(ok, F.col("cam")).otherwise(F.raise_error(F.concat(F.lit("out of bounds: "), "name")).cast("int")))
    if of.camera_map is None:
        rows = rows.withColumn("cam", F.col("cam") - 1)
    else:
        pairs = [x for kv in of.camera_map.items() for x in kv]
        rows = rows.withColumn("cam", F.element_at(F.create_map(*[F.lit(x) for x in pairs]), F.col("cam"))).where("cam is not null")
    return dense_label(rows, "pid", "pid") if relabel else rows
