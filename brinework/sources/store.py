"""A store of immutable datasets with commits and snapshots (SC-family).

A dataset's part is a Parquet folder that is written once.  A commit names its
parts with their fingerprint; committing the same content again is no change.
A snapshot is a list of commits; the pointer to the current one moves last.
Pointers are numbered files that are written once: a reader takes the last one,
and of two writers that saw the same head one fails.
Only manifests are read and written by the driver; rows never pass through it.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .digests import fingerprint


class Store:
    def __init__(self, spark: SparkSession, root: str):
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
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def _write(self, name: str, content: dict) -> None:
        """Written beside and renamed to a name that is free, so a reader never sees half a manifest.

        A name is written once: the same content again is no change, other
        content is an error, also if another writer was faster.
        """
        target, part = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(part, False)
        out.write(json.dumps(content, sort_keys=True).encode("utf-8"))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            # Unlike FileSystem.rename this one refuses an existing target on every file system.
            hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(part), self._fs.makeQualified(target), none)
        except Py4JJavaError:
            self._fs.delete(part, False)
            if self._read(name) != content:
                raise FileExistsError(f"{name} exists with other content") from None

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        found = [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(n for n in found if not n.endswith(".tmp"))

    def _pointer(self, folder: str) -> tuple[int, dict]:
        """Number and content of a pointer's latest version; 0 and nothing if there is none."""
        names = self._names(folder)
        return (int(names[-1].split(".")[0]), self._read(f"{folder}/{names[-1]}")) if names else (0, {})

    def _point(self, folder: str, after: int, content: dict) -> None:
        """The next version of a pointer. Versions are never replaced: of two writers with the same predecessor one fails."""
        self._write(f"{folder}/{after + 1:012}.json", content)

    def commit(self, dataset: str, df: DataFrame, key: list[str], parent: str | None = None) -> str:
        """Writes a part sorted by key and commits it; gives the commit's id.

        The same content as the parent's is no change and gives the parent;
        going back to earlier content is a commit of its own.  A parent that
        isn't the dataset's head is a conflict.  Repeated keys are refused.
        """
        number, pointed = self._pointer(f"heads/{dataset}")
        head = pointed.get("commit")
        if parent != head:
            raise ValueError(f"{dataset}: parent {parent} isn't the head {head}")
        mark = fingerprint(df)
        if head and self._read(f"commits/{head}.json")["fingerprint"] == mark:
            return head
        if df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
            raise ValueError(f"{dataset}: repeated keys")
        commit = f"{dataset}-{hashlib.sha256(f'{number}|{parent}|{mark}'.encode()).hexdigest()[:24]}"
        part = f"parts/{dataset}/{mark[:16]}-{uuid.uuid4().hex[:8]}"
        df.sortWithinPartitions(*key).write.mode("errorifexists").option("compression", "zstd").parquet(f"{self.root}/{part}")
        self._write(f"commits/{commit}.json", {"dataset": dataset, "parts": [part], "fingerprint": mark, "parent": parent, "schema": df.schema.jsonValue()})
        self._point(f"heads/{dataset}", number, {"commit": commit})
        return commit

    def history(self, dataset: str) -> list[dict]:
        """The dataset's commits from its head back to its first, without their schemas."""
        out, at = [], self._pointer(f"heads/{dataset}")[1].get("commit")
        while at:
            manifest = self._read(f"commits/{at}.json")
            out.append({"commit": at, **{k: manifest[k] for k in ("parts", "fingerprint", "parent")}})
            at = manifest["parent"]
        return out

    def snapshot(self, commits: list[str], checks: list[DataFrame] = ()) -> str:
        """Publishes commits as the current snapshot if no check has an offending row."""
        for check in checks:
            if not check.isEmpty():
                raise ValueError("a check has offending rows; the pointer stays")
        content = {"commits": sorted(commits)}
        name = uuid.uuid5(uuid.NAMESPACE_OID, json.dumps(content)).hex
        self._write(f"snapshots/{name}.json", content)
        number, pointed = self._pointer("current")
        if pointed.get("snapshot") != name:
            self._point("current", number, {"snapshot": name})
        return name

    def read(self, dataset: str, schema: StructType | None = None) -> DataFrame:
        """A dataset of the current snapshot, from its explicit list of parts (SC-01).

        With a schema, columns that old parts lack are null, and columns it
        doesn't know are an error.
        """
        names = self._read(f"snapshots/{self._pointer('current')[1]['snapshot']}.json")["commits"]
        parts = [p for c in names if (m := self._read(f"commits/{c}.json"))["dataset"] == dataset for p in m["parts"]]
        df = self.spark.read.option("mergeSchema", True).parquet(*(f"{self.root}/{p}" for p in parts))
        if schema is None:
            return df
        if unknown := set(df.columns) - set(schema.names):
            raise ValueError(f"{dataset}: unknown columns {sorted(unknown)}")
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))

    def orphans(self) -> list[str]:
        """Parts no commit names (SC-08)."""
        listed = {p for name in self._names("commits") for p in self._read(f"commits/{name}")["parts"]}
        found = []
        top = self._path(f"{self.root}/parts")
        if self._fs.exists(top):
            for d in self._fs.listStatus(top):
                found += [f"parts/{d.getPath().getName()}/{p.getPath().getName()}" for p in self._fs.listStatus(d.getPath())]
        return sorted(set(found) - listed)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: names made unique without regard to case, empty fields null (SC-09)."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    seen: dict[str, int] = {}
    names = []
    for c in spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path).limit(1).first() or df.columns:
        base = (c or "column").strip() or "column"
        seen[base.lower()] = seen.get(base.lower(), 0) + 1
        names.append(base if seen[base.lower()] == 1 else f"{base}_{seen[base.lower()]}")
    df = df.toDF(*names)
    return df.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns))


def write_json_lines(df: DataFrame, path: str, key: list[str]) -> None:
    """JSON lines in ranges of the key: files follow one another in order, no single writer (SC-11, SC-13)."""
    df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("errorifexists").json(path)


def unseen_parts(parts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Parts not yet processed (ST-01, ST-03)."""
    return parts.join(done.select(key).distinct(), key, "left_anti")


def attach(spark: SparkSession, store: Store, datasets: list[str], prefix: str = "") -> list[str]:
    """Registers the current snapshot's datasets as views, and what the snapshot is made of as ``snapshot_parts`` (SC-03, SC-14)."""
    name = store._pointer("current")[1]["snapshot"]
    rows = []
    for commit in store._read(f"snapshots/{name}.json")["commits"]:
        manifest = store._read(f"commits/{commit}.json")
        rows += [(name, commit, manifest["dataset"], part, manifest["fingerprint"]) for part in manifest["parts"]]
    for dataset in datasets:
        store.read(dataset).createOrReplaceTempView(prefix + dataset)
    spark.createDataFrame(rows, "snapshot string, commit string, dataset string, part string, fingerprint string").createOrReplaceTempView(prefix + "snapshot_parts")
    return [prefix + d for d in (*datasets, "snapshot_parts")]
