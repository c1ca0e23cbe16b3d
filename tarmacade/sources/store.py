"""The snapshot store: versions in a folder, staged, verified and promoted by a pointer.

    <root>/<snapshot_id>/<table>.parquet   one folder per version, never changed once written
    <root>/current.json                    the version that holds: id, version, counts, times

A version becomes current only when all its tables are written and their counts agree with what
was announced. Readers follow the pointer, so a failed import leaves the one before in place.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 1
STALE_AFTER = timedelta(hours=12)


class ImportRefused(RuntimeError):
    """A snapshot that was not promoted; the current one stays."""


class Store:
    """Snapshot versions under a root folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict[str, Any] | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/{name}").collect()))

    def _write(self, name: str, value: dict[str, Any]) -> None:
        """Writes beside the name and renames, so that readers see the old or the new text."""
        beside = self._path(f"{self.root}/.{name}.{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        target = self._path(f"{self.root}/{name}")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(beside, target, overwrite)

    def has_snapshot(self) -> bool:
        return self.current() is not None

    def last_sync(self) -> datetime | None:
        """When the version that holds was last confirmed, None before the first import."""
        held = self.current()
        return datetime.fromisoformat(held["last_sync_utc"]) if held else None

    def current(self) -> dict[str, Any] | None:
        """What is known of the version that holds, or None before the first import."""
        return self._read("current.json")

    def tables(self) -> dict[str, DataFrame]:
        """The tables of the version that holds."""
        held = self.current()
        if held is None:
            raise ImportRefused("no snapshot yet")
        return {name: self.spark.read.parquet(f"{self.root}/{held['snapshot_id']}/{name}.parquet") for name in held["counts"]}

    def stage(self, tables: Mapping[str, DataFrame], segment: str) -> dict[str, Any]:
        """Writes the tables under a new id and returns their description; nothing is promoted."""
        from tarmacade.operators.snapshot import version

        staging = f"{self.root}/staging-{uuid.uuid4().hex}"
        for name, frame in tables.items():
            frame.write.parquet(f"{staging}/{name}.parquet")
        # Fingerprints are taken of what was written, not of another run of its plan.
        written = {name: self.spark.read.parquet(f"{staging}/{name}.parquet") for name in tables}
        prints = {r["table"]: (r["rows"], r["hash"]) for r in version(written).collect()}  # one row per table
        digest = hashlib.sha256(json.dumps(prints, sort_keys=True).encode()).hexdigest()[:16]
        snapshot_id = f"{SCHEMA_VERSION}-{digest}-{segment}"
        return {
            "schema_version": SCHEMA_VERSION, "data_version": digest, "snapshot_id": snapshot_id, "segment": segment,
            "counts": {name: n for name, (n, _) in prints.items()}, "staging": staging,
            "generated_at": datetime.now(UTC).isoformat(),
        }

    def promote(self, staged: Mapping[str, Any], expected: Mapping[str, int] | None = None) -> dict[str, Any]:
        """Makes a staged version current, or refuses and removes it.

        Refused if the schema version differs, a table that was announced is missing, or its
        count differs from the announced one.
        """
        staging = self._path(staged["staging"])
        try:
            if staged["schema_version"] != SCHEMA_VERSION:
                raise ImportRefused(f"schema version {staged['schema_version']}")
            for name, n in (expected or {}).items():
                if staged["counts"].get(name) != n:
                    raise ImportRefused(f"{name}: {staged['counts'].get(name)} rows instead of {n}")
        except ImportRefused:
            self._fs.delete(staging, True)
            raise
        target = self._path(f"{self.root}/{staged['snapshot_id']}")
        if self._fs.exists(target):  # the same content came before
            self._fs.delete(staging, True)
        else:
            self._fs.rename(staging, target)
        held = {k: v for k, v in staged.items() if k != "staging"} | {"last_sync_utc": datetime.now(UTC).isoformat()}
        self._write("current.json", held)
        return held

    def sync(self, build: Any, segment: str = "full", force: bool = False, now: datetime | None = None) -> dict[str, Any]:
        """Rebuilds and promotes if forced, missing or older than STALE_AFTER; else returns what holds."""
        held = self.current()
        if held and not force and (now or datetime.now(UTC)) - datetime.fromisoformat(held["last_sync_utc"]) < STALE_AFTER:
            return held
        return self.promote(self.stage(build(segment), segment))


def write_cases(cases: DataFrame, folder: str) -> None:
    """One JSON line per case, for other implementations to compare with; absent fields are left out."""
    cases.write.mode("overwrite").json(folder)
