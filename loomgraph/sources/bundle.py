"""Immutable generations of tables behind a pointer (O-19 to O-21, O-136, S-8)."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.errors import CapabilityDowngrade, NoGeneration

HEADS = ("HEAD.0.json", "HEAD.1.json")


class Bundle:
    """A folder of generations. Two pointer files take turns; each holds a checksum, and the newest valid one counts, so a
    torn write leaves the other. All access goes through Hadoop's file systems. One writer at a time is assumed."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            body = json.loads(text)
            given = body.pop("checksum")
        except (ValueError, KeyError, AttributeError):
            return None
        return body if given == self._sum(body) else None

    @staticmethod
    def _sum(body: dict) -> str:
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()

    def heads(self) -> list[dict]:
        """Valid pointers, the newest first."""
        found = [h for h in map(self._read, HEADS) if h and self._fs.exists(self._path(f"{self.root}/{h['generation_id']}"))]
        return sorted(found, key=lambda h: -h["sequence"])

    def resolve(self) -> dict:
        """O-21: the newest pointer that validates and whose generation exists, else the other; generations without a pointer are never looked for."""
        found = self.heads()
        if not found:
            raise NoGeneration(self.root)
        return found[0]

    def publish(self, tables: dict[str, DataFrame], capabilities: list[list[str]] | None = None, allow_downgrade: bool = False) -> str:
        """O-19, O-20: write a new generation aside, move it into place, then switch the older pointer to it.

        A generation that loses a complete capability of the one before is refused unless a downgrade is allowed.
        """
        now = self.heads()
        have = sorted(map(list, capabilities or []))
        if now and not allow_downgrade and (lost := [c for c in now[0]["capabilities"] if c not in have]):
            raise CapabilityDowngrade(str(lost))
        name = f"g{(now[0]['sequence'] + 1) if now else 1:08d}-{uuid.uuid4().hex[:12]}"
        staging = f"{self.root}/.staging-{name}"
        for table, df in tables.items():
            df.write.parquet(f"{staging}/{table}")
        if not self._fs.rename(self._path(staging), self._path(f"{self.root}/{name}")):
            raise OSError(f"cannot move {staging}")
        body = {"generation_id": name, "sequence": now[0]["sequence"] + 1 if now else 1, "parent": now[0]["generation_id"] if now else None, "tables": sorted(tables), "capabilities": have}
        slot = HEADS[body["sequence"] % 2]
        stream = self._fs.create(self._path(f"{self.root}/{slot}"), True)
        stream.write(bytearray(json.dumps(body | {"checksum": self._sum(body)}).encode()))
        stream.close()
        return name

    def open(self, table: str, generation: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{generation or self.resolve()['generation_id']}/{table}")
