"""Immutable revisions of materials as a data source: staged by tasks, put in place at the commit, never changed after.

A revision is a folder ``<root>/<material_id>/<revision_id>`` of named payloads on a file system that the driver and
all executors mount. Rows are material_id, revision_id, name and payload. Tasks write below a staging folder of the job
in the same root; only the commit renames whole revisions into place, so a failed task or job leaves none. A revision
that exists already must have the same files: it is left as it is, or the commit fails and nothing new is put in place.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "attestra_revisions"
KEYS = ("material_id", "revision_id")
_STAGING = ".staging-"


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: (material_id, revision_id, folder)."""

    revisions: list[tuple[str, str, str]]


def _safe(name: str | None) -> str:
    if not name or name.startswith(".") or "/" in name or "\0" in name:
        raise ValueError(f"unsafe name of a revision or payload: {name!r}")
    return name


def digests(folder: str) -> dict[str, str]:
    """sha256 of each file of a folder by name."""
    out = {}
    for name in sorted(os.listdir(folder)):
        with open(f"{folder}/{name}", "rb") as f:
            out[name] = hashlib.file_digest(f, "sha256").hexdigest()
    return out


class _Writer(DataSourceWriter):
    def __init__(self, root: str, required: tuple[str, ...]) -> None:
        self.root, self.required = root, required
        self.stage = f"{root}/{_STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        task = TaskContext.get()
        own = f"{self.stage}/{task.partitionId()}-{task.taskAttemptId()}"
        held: dict[tuple[str, str], str] = {}
        for row in iterator:
            key = (_safe(row["material_id"]), _safe(row["revision_id"]))
            folder = held.setdefault(key, f"{own}/{key[0]}/{key[1]}")
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{_safe(row['name'])}", "xb") as f:  # a payload that repeats fails
                f.write(row["payload"] or b"")
                f.flush()
                os.fsync(f.fileno())
        for (material, revision), folder in held.items():
            missing = set(self.required) - set(os.listdir(folder))
            if missing:
                raise ValueError(f"revision {material}/{revision} lacks {sorted(missing)}")
        return Staged([(*key, folder) for key, folder in held.items()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        staged = [r for m in messages if m is not None for r in m.revisions]
        try:
            fresh = []
            for material, revision, folder in staged:
                final = f"{self.root}/{material}/{revision}"
                if not os.path.isdir(final):
                    fresh.append((folder, final))
                elif digests(final) != digests(folder):
                    raise ValueError(f"identity_conflict: revision {material}/{revision} exists with other content")
            if len({final for _, final in fresh}) < len(fresh):
                raise ValueError("a revision's rows are in more than one task; partition by material_id and revision_id")
            for folder, final in fresh:
                os.makedirs(os.path.dirname(final), exist_ok=True)
                os.rename(folder, final)
        finally:
            shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class RevisionSource(DataSource):
    """Options: path (the root), required (names that every revision must have, by commas)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "material_id string, revision_id string, name string, payload binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("revisions are never overwritten; append")
        return _Writer(self.options["path"].removeprefix("file://").rstrip("/"), tuple(n for n in self.options.get("required", "").split(",") if n))


def append_revisions(rows: DataFrame, root: str, required: tuple[str, ...] = ()) -> None:
    """Append revisions (material_id, revision_id, name, payload); each is written by one task, all or none are kept.

    The commit renames one folder a revision on the driver, as file formats do with files.
    """
    rows.sparkSession.dataSource.register(RevisionSource)
    spread = rows.select(*KEYS, "name", "payload").repartition(*KEYS)
    spread.write.format(FORMAT).option("required", ",".join(required)).mode("append").save(root)


def classify(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """(material_id, revision_id, status) of ``expected`` (material_id, revision_id, name, sha256) against what is stored.

    ``valid``: all files with their hashes and no others; ``conflict``: a file differs or is not expected; ``partial``:
    some are missing; ``missing``: none is there. Spark reads the files and hashes them where they are read.
    """
    path = F.regexp_extract_all("path", F.lit("[^/]+"), F.lit(0))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(path.alias("p"), F.sha2("content", 256).alias("stored"))
    part = lambda k: F.try_element_at("p", F.lit(-k))
    files = files.where(~part(3).startswith(".")).select(part(3).alias("material_id"), part(2).alias("revision_id"), part(1).alias("name"), "stored")
    files = files.join(expected.select(*KEYS).distinct(), list(KEYS), "left_semi")
    j = expected.join(files, [*KEYS, "name"], "full").groupBy(*KEYS)
    told = j.agg(F.count_if(F.col("stored").isNull()).alias("absent"), F.count_if(F.col("stored").isNotNull()).alias("there"), F.count_if(F.col("stored").isNotNull() & ~F.col("stored").eqNullSafe(F.col("sha256"))).alias("wrong"))
    status = F.when(F.col("wrong") > 0, "conflict").when(F.col("there") == 0, "missing").when(F.col("absent") > 0, "partial").otherwise("valid")
    return told.select(*KEYS, status.alias("status"))
