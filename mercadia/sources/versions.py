"""Published versions: a refresh that readers see whole or not at all.

Each refresh writes into a folder of its own below ``versions``. When all of it is written,
one small manifest is put into place by a rename; it names the folder of every table. Readers follow the
manifest with the highest number, so a refresh that stops anywhere leaves what was published before
it, and parents never meet children of another load. Versions beyond the last ``KEEP`` go
after a publish, as do folders that older attempts left without one; a reader that opened
the version before has one whole refresh time to end.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from mercadia.sources import buckets

MANIFESTS, VERSIONS = "_manifests", "versions"
KEEP = 2


@dataclass(frozen=True)
class Manifest:
    """Tables by name (like ``base/orders``): ``path`` below the root and, where they have one, their layout."""
    number: int
    root: str
    tables: dict[str, dict]

    def names(self, group: str) -> list[str]:
        return [n.split("/", 1)[1] for n in self.tables if n.split("/", 1)[0] == group]

    def path(self, name: str) -> str:
        return f"{self.root}/{self.tables[name]['path']}"

    def paths(self) -> dict[str, str]:
        return {n: self.path(n) for n in self.tables}

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        layout = self.tables[name].get("layout")
        return buckets.read(spark, self.path(name), layout) if layout else spark.read.parquet(self.path(name))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, folder: str) -> None:
    p, fs = _path(spark, folder)
    fs.delete(p, True)


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in children(spark, f"{root}/{MANIFESTS}")
            if n.endswith(".json") and not n.startswith((".", "_"))]


def _load(spark: SparkSession, root: str, number: int) -> Manifest:
    p, fs = _path(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(number, root, json.loads(text)["tables"])


def current(spark: SparkSession, root: str) -> Manifest | None:
    """What was published last, or None."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    return _load(spark, root, max(numbers)) if numbers else None


def of_group(spark: SparkSession, folder: str, group: str) -> Manifest | None:
    """The manifest that covers ``folder``: a published root, or its subfolder ``group``."""
    folder = folder.rstrip("/")
    found = current(spark, folder)
    if found is None and folder.rpartition("/")[2] == group:
        found = current(spark, folder.rpartition("/")[0])
    return found


class Version:
    """A version that is being written to ``folder``; nobody reads it before :meth:`publish`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.number = max(_numbers(spark, self.root), default=0) + 1
        self.name = f"{VERSIONS}/{self.number:012d}-{uuid.uuid4().hex}"
        self.folder = f"{self.root}/{self.name}"

    def publish(self, paths: dict[str, str], layouts: dict[str, dict] | None = None) -> Manifest:
        """Puts the manifest of the written ``paths`` into place and removes what is out of date."""
        layouts = layouts or {}
        tables = {n: {"path": p.removeprefix(self.root + "/"), **({"layout": layouts[n]} if n in layouts else {})}
                  for n, p in paths.items()}
        final, fs = _path(self.spark, f"{self.root}/{MANIFESTS}/{self.number:012d}.json")
        unseen, _ = _path(self.spark, f"{self.root}/{MANIFESTS}/.{uuid.uuid4().hex}")
        fs.mkdirs(final.getParent())
        stream = fs.create(unseen, True)
        try:
            stream.write(json.dumps({"tables": tables}).encode("utf-8"))
        finally:
            stream.close()
        if fs.exists(final) or not fs.rename(unseen, final):
            fs.delete(unseen, False)
            raise RuntimeError(f"another refresh has published version {self.number} of {self.root} meanwhile")
        self._clear()
        return _load(self.spark, self.root, self.number)

    def _clear(self) -> None:
        numbers = sorted(_numbers(self.spark, self.root))
        kept = {_load(self.spark, self.root, n).tables[t]["path"].split("/")[1]
                for n in numbers[-KEEP:] for t in _load(self.spark, self.root, n).tables}
        for n in numbers[:-KEEP]:
            old = _load(self.spark, self.root, n)
            for name, table in old.tables.items():
                if table.get("layout"):
                    buckets.forget(self.spark, old.path(name))
            remove(self.spark, f"{self.root}/{MANIFESTS}/{n:012d}.json")
        for folder in children(self.spark, f"{self.root}/{VERSIONS}"):
            # an attempt of this number may still be at work
            if folder not in kept and int(folder.split("-")[0]) < self.number:
                remove(self.spark, f"{self.root}/{VERSIONS}/{folder}")
