"""Tables in files: CSV, TSV, JSON, parquet, JDBC; blobs; backups."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from ..collection import Database


def csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", null: str = "") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True, nullValue=null, escape='"', multiLine=False)


def tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    r"""Tab-separated with a header; ``\N`` is null, quotes are ordinary characters."""
    return spark.read.csv(path, schema=schema, sep="\t", header=True, nullValue="\\N", quote="")


def json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int | None = None, high: int | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database's table, read in parts by ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def dynamic(spark: SparkSession, path: str, key: str = "_id") -> DataFrame:
    """Documents without a schema: (_id, json); fields come out by ``values.json_field``."""
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", f"$.{key}").alias("_id"), F.col("value").alias("json"))


def key_values(df: DataFrame, key: str = "_id") -> DataFrame:
    """(_id, json) of any table."""
    return df.select(F.col(key).cast("string").alias("_id"), F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def backup(db: Database, folder: str) -> dict[str, str]:
    """Each collection as a folder of JSON lines under ``folder``."""
    out = {}
    for name, c in db.collections.items():
        out[name] = f"{folder}/{name}.jsonl"
        write_json(c.stored, out[name])
    return out


def restore(db: Database, folder: str) -> None:
    """Replace each collection's rows by the backup's."""
    for name, c in db.collections.items():
        c.stored = db.spark.read.schema(c.stored.schema).json(f"{folder}/{name}.jsonl")


def zip_backup(folder: str, target: str) -> None:
    """One file of a backup in a local folder; each collection's part files become one entry."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(os.listdir(folder)):
            with z.open(name, "w") as out:
                for part in sorted(p for p in os.listdir(f"{folder}/{name}") if p.startswith("part-")):
                    with open(f"{folder}/{name}/{part}", "rb") as f:
                        while block := f.read(1 << 20):
                            out.write(block)


def unzip_backup(source: str, folder: str) -> None:
    with zipfile.ZipFile(source) as z:
        for name in z.namelist():
            if "/" in name or name.startswith("."):
                raise ValueError(f"unexpected entry {name}")
            os.makedirs(f"{folder}/{name}", exist_ok=True)
            with z.open(name) as f, open(f"{folder}/{name}/part-00000.json", "wb") as out:
                while block := f.read(1 << 20):
                    out.write(block)


def blob_chunks(df: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """(path, n, data) of a binaryFile table: files in ordered chunks, cut without Python."""
    size = F.length("content")
    n = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / chunk).cast("int") - 1, F.lit(0))))
    return df.select("path", "content", n.alias("n")).select("path", "n", F.substring(F.col("content"), F.col("n") * chunk + 1, F.lit(chunk)).alias("data"))


def read_blob(chunks: DataFrame, path: str) -> Iterator[bytes]:
    """A file's chunks in their order, a partition at a time."""
    for r in chunks.where(F.col("path") == F.lit(path)).orderBy("n").toLocalIterator():
        yield bytes(r["data"])
