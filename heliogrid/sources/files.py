"""Small files and folders on whatever file system Spark has for a path: existence, moves, and a state that is switched at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has something at path."""
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; none for a folder that isn't there."""
    fs, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, source: str, destination: str) -> None:
    """Renames a folder, in place of what is there; a source that is gone was moved before."""
    fs, where = _at(spark, source)
    if not fs.exists(where):
        return
    _, to = _at(spark, destination)
    fs.delete(to, True)
    fs.mkdirs(to.getParent())
    if not fs.rename(where, to):
        raise OSError(f"{source} could not be moved to {destination}")


def rename_suffix(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Renames the files of a folder that end in old."""
    for name in names(spark, folder):
        if name.endswith(old):
            fs, where = _at(spark, f"{folder}/{name}")
            fs.rename(where, _at(spark, f"{folder}/{name.removesuffix(old)}{new}")[1])


class State:
    """A folder's state as a small JSON document in numbered files, of which the last one counts.

    A new one is written under another name and renamed: readers see the state
    before or the state after. Of two writers that go on from one state the second
    fails (for certain where a rename doesn't replace files, as on HDFS). The last `keep` files stay for readers that are under way.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path, keep

    def read(self) -> tuple[int, dict]:
        """(number, document); 0 and none at the start."""
        numbers = [int(n[6:-5]) for n in names(self.spark, self.path) if n.startswith("state-") and n.endswith(".json")]
        if not numbers:
            return 0, {}
        fs, where = _at(self.spark, f"{self.path}/state-{max(numbers):09d}.json")
        stream = fs.open(where)
        try:
            return max(numbers), json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def switch(self, after: int, document: dict) -> int:
        """Makes document the state that follows number `after`."""
        fs, to = _at(self.spark, f"{self.path}/state-{after + 1:09d}.json")
        _, draft = _at(self.spark, f"{self.path}/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        stream.close()
        if fs.exists(to) or not fs.rename(draft, to):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.path} has been changed by another writer")
        for name in names(self.spark, self.path):
            if name.startswith("state-") and int(name[6:-5]) <= after + 1 - self.keep:
                drop(self.spark, f"{self.path}/{name}")
        return after + 1


class Tiers:
    """Segments of a table that only grows: each batch adds one, and `fanout` of a level are merged to one of the next.

    So `fanout` segments a level are live at most, whatever the number of batches,
    and each row is written once a level. The list of live segments is a State:
    a merge that breaks off leaves the list as it was. Segments that a merge
    replaces are deleted one merge later, when no reader of the list before has them.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 8):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.state = State(spark, f"{self.path}/state")

    def folder(self, name: str) -> str:
        return f"{self.path}/segments/{name}"

    def live(self) -> list[dict]:
        return self.state.read()[1].get("segments", [])

    def add(self, batch: str, write) -> None:
        """Adds what write(folder) writes, which returns its facts, as the segment of a batch, in place of one of an
        earlier run of it. A folder of its own for each attempt: until it is listed, what is listed stays whole."""
        name = f"{batch}-{uuid.uuid4().hex[:12]}"
        facts = write(self.folder(name))
        number, s = self.state.read()
        segments = s.get("segments", [])
        before = [x["name"] for x in segments if x.get("batch") == batch]
        kept = [x for x in segments if x["name"] not in before]
        self.state.switch(number, {"segments": [*kept, {"name": name, "level": 0, "batch": batch, **facts}], "retired": [*s.get("retired", []), *before]})

    def merge(self, write, but: str | None = None) -> list[str]:
        """Merges every level that is full. write(names, folder) writes those segments as one and returns its
        facts. The segment of batch `but` is left alone. Returns the names of new segments."""
        made = []
        while True:
            number, s = self.state.read()
            levels: dict[int, list[dict]] = {}
            for x in s.get("segments", []):
                if but is None or x.get("batch") != but:
                    levels.setdefault(x["level"], []).append(x)
            full = next((k for k in sorted(levels) if len(levels[k]) >= self.fanout), None)
            if full is None:
                return made
            parts = [x["name"] for x in levels[full]]
            name = f"level{full + 1}-{uuid.uuid4().hex[:12]}"
            facts = write(parts, self.folder(name))
            rest = [x for x in s["segments"] if x["name"] not in parts]
            self.state.switch(number, {"segments": [*rest, {"name": name, "level": full + 1, **facts}], "retired": parts})
            made.append(name)
            for old in s.get("retired", []):
                drop(self.spark, self.folder(old))
