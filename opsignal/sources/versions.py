"""Tables as committed versions: a write becomes visible as a whole or not at all.

A table is a folder with ``data``, where every write has a folder of its own that never changes, and
``versions``, one small manifest for each commit that lists the data folders of the version. Readers take
the newest manifest. A write that fails leaves a data folder that no manifest names.

Columns that all rows of a key share may have a data folder of their own, one row a key: readers join them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Version:
    """Data folders of a table by part (one part named "" where the table has none), relative to its path."""

    path: str
    schema: T.StructType
    folders: dict[str, str]
    digests: dict[str, list] = field(default_factory=dict)
    layout: list = field(default_factory=list)  # key columns and number of parts of a keyed copy
    number: int | None = None
    shared: dict = field(default_factory=dict)  # of columns that have one row a key: key, columns, folder

    def read(self, spark: SparkSession, parts: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The rows, or those of some parts."""
        schema = schema or self.schema
        wanted = [f"{self.path}/{f}" for p, f in sorted(self.folders.items()) if parts is None or p in parts]
        if not wanted:
            return spark.createDataFrame([], schema)
        apart = [c for c in self.shared.get("columns", []) if c in schema.names]
        if not apart:
            return spark.read.schema(schema).parquet(*wanted)
        key = self.shared["key"]
        rows = spark.read.schema(_only(self.schema, [c for c in self.schema.names if c not in self.shared["columns"]])).parquet(*wanted)
        once = spark.read.schema(_only(self.schema, [key, *apart])).parquet(f"{self.path}/{self.shared['folder']}")
        return rows.join(once, key, "left").select(*schema.names)


def _only(schema: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([schema[n] for n in names])


def new_data_folder() -> str:
    return f"data/{uuid.uuid4().hex}"


def prepared(df: DataFrame, path: str, partition_by: str | None = None) -> Version:
    """Data of the next version, written but not visible yet."""
    path, folder = path.rstrip("/"), new_data_folder()
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(f"{path}/{folder}")
    # the reader puts the column that folders are named by last
    columns = [f for f in df.schema.fields if f.name != partition_by] + [f for f in df.schema.fields if f.name == partition_by]
    return Version(path, T.StructType(columns), {"": folder})


def with_shared(version: Version, df: DataFrame, key: str, columns: list[str]) -> Version:
    """The prepared version with the columns of ``df`` besides ``key``, written once for each key, which no two rows of
    ``df`` may have in common. ``columns`` is the order of the whole table."""
    folder = new_data_folder()
    df.write.parquet(f"{version.path}/{folder}")
    fields = {f.name: f for f in [*df.schema.fields, *version.schema.fields]}
    shared = {"key": key, "columns": [c for c in df.columns if c != key], "folder": folder}
    return replace(version, schema=T.StructType([fields[c] for c in columns]), shared=shared)


def commit(spark: SparkSession, version: Version) -> Version:
    """Makes a prepared version the newest one. One writer a table at a time; a manifest that two have written is
    refused by the readers."""
    last = _manifests(spark, version.path)
    number = max(last, default=0) + 1
    content = {"schema": version.schema.jsonValue(), "folders": version.folders, "digests": version.digests, "layout": version.layout}
    content |= {"shared": version.shared} if version.shared else {}
    row = spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1)
    row.write.mode("errorifexists").text(f"{version.path}/versions/{number:012}")
    return replace(version, number=number)


def _manifests(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed manifests by number: a few lines, one a version that has not expired."""
    try:
        lines = spark.read.text(f"{path}/versions/*").select(F.input_file_name().alias("file"), "value").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    out: dict[int, str] = {}
    for r in lines:
        number = int(r.file.rsplit("/", 2)[-2])
        if number in out:
            raise RuntimeError(f"{path}: version {number} was committed by two writers")
        out[number] = r.value
    return out


def version_of(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The newest committed version, or the one with this number; None where there is none."""
    path = path.rstrip("/")
    found = _manifests(spark, path)
    if not found or (number is not None and number not in found):
        return None
    number = max(found) if number is None else number
    content = json.loads(found[number])
    return Version(path, T.StructType.fromJson(content["schema"]), content["folders"], content["digests"], content["layout"], number, content.get("shared", {}))


def read_table(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """Rows of the newest committed version, or of an earlier one."""
    version = version_of(spark, path, number)
    if version is None:
        raise FileNotFoundError(f"{path}: no such committed version")
    return version.read(spark)


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the manifests before the newest ``keep`` and every data folder that none of these names, left-overs
    of failed writes too; gives the number of data folders deleted. No write may run meanwhile."""
    path = path.rstrip("/")
    found = _manifests(spark, path)
    kept = sorted(found)[-keep:]
    contents = [json.loads(found[n]) for n in kept]
    named = {f.split("/")[1] for c in contents for f in c["folders"].values()}
    named |= {c["shared"]["folder"].split("/")[1] for c in contents if c.get("shared")}
    jvm = spark.sparkContext._jvm
    at = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join([path, *p]))
    files = at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in set(found) - set(kept):
        files.delete(at("versions", f"{n:012}"), True)
    gone = [s.getPath().getName() for s in files.listStatus(at("data")) if s.getPath().getName() not in named]
    for name in gone:
        files.delete(at("data", name), True)
    return len(gone)
