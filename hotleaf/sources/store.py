"""Versioned storage of split documents on any file system Spark can reach.

A relation is a folder.  ``meta/<version>.json`` describes it; creating the next such file is the commit, and it
fails if someone else made it first.  Rows lie in ``hot/p=<bucket>/v=<version>`` (id, revision, hot values, business columns)
and ``cold/p=<bucket>/v=<version>`` (id, template).  A commit writes the buckets it touches and leaves all others, so a hot change
leaves every cold file as it is.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotleaf.errors import DocError

FORMAT = 3


@dataclass
class Meta:
    name: str
    paths: list[list[str | int]]
    columns: dict[str, str] = field(default_factory=dict)
    version: int = 0
    format: int = FORMAT
    epoch: str = field(default_factory=lambda: str(uuid.uuid4()))
    generation: int = 1
    next_revision: int = 1
    partition: dict = field(default_factory=lambda: {"strategy": "hash", "modulus": 8})
    hot: dict[str, int] = field(default_factory=dict)
    cold: dict[str, int] = field(default_factory=dict)
    not_null: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    collations: dict[str, str] = field(default_factory=dict)
    checks: dict[str, dict] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, dict] = field(default_factory=dict)
    rls: dict = field(default_factory=lambda: {"enabled": False, "force": False})
    policies: dict[str, dict] = field(default_factory=dict)
    access: dict[str, str] = field(default_factory=dict)
    fenced: bool = False
    follower: str | None = None
    applied: int = -1
    jobs: dict[str, dict] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def of(cls, text: str) -> Meta:
        raw = json.loads(text)
        if raw.get("format") not in (2, FORMAT):
            raise DocError("0A000", f"unknown format {raw.get('format')!r}")
        return cls(**raw | {"format": FORMAT})

    def layout(self) -> dict[str, Any]:
        return {"paths": self.paths, "columns": self.columns, "partition": self.partition, "types": self.types}


class Files:
    """The few file operations that are needed, through Hadoop's interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def size(self, folder: str) -> int:
        at = self.path(folder)
        return self.fs.getContentSummary(at).getLength() if self.fs.exists(at) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if the file exists."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise DocError("55000", f"cannot rename {old}")


class Store:
    """One relation's files."""

    def __init__(self, spark: SparkSession, files: Files, name: str):
        self.spark, self.files, self.name = spark, files, name

    def meta(self) -> Meta:
        found = [n for n in self.files.names(f"{self.name}/meta") if n.endswith(".json")]
        if not found:
            raise DocError("42704", f"no relation {self.name}")
        return Meta.of(self.files.read(f"{self.name}/meta/{found[-1]}"))

    def publish(self, meta: Meta) -> Meta:
        """Makes ``meta`` the version after the one it was read from."""
        meta.version += 1
        if not self.files.create(f"{self.name}/meta/{meta.version:020d}.json", meta.text()):
            raise DocError("40001", f"{self.name} was changed by another commit")
        return meta

    def write(self, side: str, rows: DataFrame, version: int) -> None:
        """Files sorted by id; large buckets are dealt over several tasks by ranges of ids."""
        (rows.withColumn("v", F.lit(version)).repartitionByRange("p", "id").sortWithinPartitions("p", "id").write.mode("append").partitionBy("p", "v").parquet(f"{self.files.root}/{self.name}/{side}"))

    def read(self, side: str, buckets: dict[str, int], schema: str) -> DataFrame:
        base = f"{self.files.root}/{self.name}/{side}"
        if not buckets:
            return self.spark.createDataFrame([], re.sub(r"\bvar?char\(\d+\)", "string", schema))
        folders = [f"{base}/p={p}/v={v}" for p, v in sorted(buckets.items())]
        return self.spark.read.schema(f"{schema}, v long").option("basePath", base).parquet(*folders).drop("v")
