"""A folder of typed tables under a versioned manifest.

A commit writes new Parquet folders and then a new manifest, whose name is its version; readers take the newest
manifest that is whole. So a commit is all or nothing, and readers see one state. A table is a list of folders, and
appending adds one. Files go through Hadoop's file system, so the folder may be anywhere Spark can write. Of two
writers one is refused, as its manifest's rename finds the version taken: local file systems and HDFS promise that,
object stores don't, and there one writer at a time may commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Dropped, NameTaken, NotFound, ReadOnly, SchemaError
from ..functions.types import conformed, struct
from ..operators import structures, vectors
from ..operators.collection import Collection, Index, Many, Range, Search, Unique, Vector, dangling
from ..operators.dataset import Dataset
from ..operators.fulltext import SearchIndex
from ..operators.sketches import Bloom, CountingBloom

KINDS = ("dataset", "collection", "map", "ordered", "sequence", "set", "queue", "priority", "lru", "bloom", "counting_bloom", "graph", "search", "flat", "ivf")
OPTIONS: dict[str, dict[str, Any]] = {
    "bloom": {"expected": 10_000, "rate": 0.01}, "counting_bloom": {"expected": 10_000, "rate": 0.01, "max_count": 255},
    "map": {"key": "_key"}, "ordered": {"key": "_key"}, "sequence": {"pos": "_pos", "valid": "_valid"}, "set": {"column": "member"},
    "queue": {"seq": "_seq"}, "priority": {"priority": "priority", "seq": "_seq", "max_first": True}, "lru": {"capacity": 1000, "key": "_key", "used": "_used"},
    "flat": {"dim": None, "metric": "cosine"}, "ivf": {"dim": None, "metric": "cosine", "n_clusters": 256, "pq": False, "n_sub": 16, "n_bits": 8},
    "search": {"text_fields": None, "ignore_case": True, "ignore_accent": True, "scoring": "boolean", "k1": 1.5, "b": 0.75}, "graph": {"directed": True, "label_field": None},
    "dataset": {}, "collection": {"primary": None, "indexes": None},
}
_NEEDED = {"flat": {"dim": "int64"}, "ivf": {"dim": "int64"}, "search": {"text_fields": "text"}}
_FIELDS = {"bloom": {"bit": "int64"}, "counting_bloom": {"bit": "int64", "n": "int64"}}
_INDEXES = {c.__name__: c for c in (Unique, Range, Many, Search, Vector)}


class Catalog:
    """Open or create; flag 'r' reads only."""

    def __init__(self, spark: SparkSession, folder: str, flag: str = "c"):
        self.spark, self.folder, self.readonly = spark, folder.rstrip("/"), flag == "r"
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._staged: dict[str, Any] | None = None
        self.version, self.entries = self._newest()

    # manifests

    def _path(self, *parts: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _newest(self) -> tuple[int, dict[str, Any]]:
        if not self._fs.exists(self._path("_manifests")):
            return 0, {}
        names = sorted((f.getPath().getName() for f in self._fs.listStatus(self._path("_manifests"))), reverse=True)
        for name in names:
            if not name.endswith(".json") or name.startswith((".", "_")):
                continue
            try:
                text = self.spark.read.text(f"{self.folder}/_manifests/{name}", wholetext=True).first()[0]
                return int(name[:-5]), json.loads(text)
            except (ValueError, TypeError):  # a torn manifest: the one before it holds
                continue
        return 0, {}

    def _publish(self, entries: dict[str, Any]) -> None:
        version = self.version + 1
        temporary = self._path("_manifests", f".{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(entries).encode()))
        out.close()
        if not self._fs.rename(temporary, self._path("_manifests", f"{version:012d}.json")):
            self._fs.delete(temporary, False)
            raise NameTaken(f"version {version} was written by another")
        self.version, self.entries = version, entries

    def refresh(self) -> None:
        self.version, self.entries = self._newest()

    @contextmanager
    def durable(self) -> Iterator[Catalog]:
        """All changes within are published together, or none."""
        if self._staged is not None:
            yield self
            return
        self._writable()
        self._staged = json.loads(json.dumps(self.entries))
        try:
            yield self
            staged, self._staged = self._staged, None
            self._publish(staged)
        finally:
            self._staged = None

    def _writable(self) -> None:
        if self.readonly:
            raise ReadOnly(self.folder)

    def _now(self) -> dict[str, Any]:
        return self.entries if self._staged is None else self._staged

    def _change(self, change: Callable[[dict[str, Any]], None]) -> None:
        with self.durable():
            change(self._staged)

    # structures

    def create(self, name: str, kind: str = "dataset", fields: dict[str, str] | None = None, exist_ok: bool = False, **options: Any) -> dict[str, Any]:
        """Declares a structure: a name, its fields and options, which have defaults by kind. No job runs."""
        self._writable()
        if kind not in KINDS:
            raise SchemaError(f"no kind {kind}")
        if unknown := set(options) - set(OPTIONS[kind]):
            raise SchemaError(f"{kind} has no options {sorted(unknown)}")
        if missing := set(_NEEDED.get(kind, ())) - set(options):
            raise SchemaError(f"{kind} needs {sorted(missing)}")
        options = {**OPTIONS[kind], **options}
        if kind in ("flat", "ivf") and (options["metric"] not in vectors.METRICS or options["dim"] < 1):
            raise SchemaError("no such metric, or no dimension")
        if kind in ("bloom", "counting_bloom") and not (options["expected"] > 0 and 0 < options["rate"] < 1):
            raise SchemaError("expected must be positive, and rate between 0 and 1")
        if kind == "lru" and options["capacity"] < 1:
            raise SchemaError("capacity must be positive")
        fields = fields or _FIELDS.get(kind) or ({"id": "int64", "vec": f"float64[{options['dim']}]"} if kind in ("flat", "ivf") else {})
        struct(fields)
        if name in self._now():
            if exist_ok:
                return self._now()[name]
            raise NameTaken(name)
        entry = {"kind": kind, "fields": fields, "options": options, "paths": [], "id": uuid.uuid4().hex}
        self._change(lambda e: e.__setitem__(name, entry))
        return entry

    def collection(self, name: str, fields: dict[str, str] | None = None, primary: str | None = None, indexes: dict[str, Index] | None = None) -> Collection:
        """Declares a collection, or opens it where fields are left out."""
        if fields is not None:
            if primary not in fields:
                raise SchemaError("one primary field")
            specs = {k: [type(v).__name__, dict(v.__dict__)] for k, v in (indexes or {}).items()}
            self.create(name, "collection", fields, primary=primary, indexes=specs)
        entry = self.entry(name)
        made = {k: _INDEXES[c](**{f: tuple(v) if isinstance(v, list) else v for f, v in args.items()}) for k, (c, args) in (entry["options"]["indexes"] or {}).items()}
        return Collection(self.read(name), entry["options"]["primary"], made)

    def entry(self, name: str) -> dict[str, Any]:
        if name not in self._now():
            raise NotFound(name)
        return self._now()[name]

    def open(self, name: str) -> Any:
        """The structure as an object over its rows, by its kind; `save` takes the changed one."""
        entry = self.entry(name)
        kind, o, df = entry["kind"], entry["options"], self.read(name)
        made: dict[str, Callable[[], Any]] = {
            "collection": lambda: self.collection(name),
            "dataset": lambda: Dataset(df, name),
            "map": lambda: structures.KeyedMap(df, o["key"]),
            "ordered": lambda: structures.OrderedMap(df, o["key"]),
            "sequence": lambda: structures.Sequence(df, o["pos"], o["valid"]),
            "set": lambda: structures.StringSet(df, o["column"]),
            "queue": lambda: structures.Fifo(df, o["seq"]),
            "priority": lambda: structures.PriorityQueue(df, o["priority"], o["seq"], o["max_first"]),
            "lru": lambda: structures.LruMap(df, o["capacity"], o["key"], o["used"]),
            "bloom": lambda: Bloom(o["expected"], o["rate"]),
            "counting_bloom": lambda: CountingBloom(o["expected"], o["rate"], o["max_count"]),
            "flat": lambda: vectors.FlatIndex(df, o["dim"], o["metric"]),
            "ivf": lambda: vectors.InvertedFile(o["metric"], o["n_clusters"], o["n_sub"] if o["pq"] else 0, o["n_bits"]),
            "search": lambda: self._search_index(name, o),
        }
        if kind not in made:
            raise SchemaError(f"{kind} has no object")
        return made[kind]()

    def _search_index(self, name: str, o: dict[str, Any]) -> SearchIndex:
        folder = f"{self.folder}/_search/{self.entry(name)['id']}"
        if self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(f"{folder}/index.json")):
            return SearchIndex.open(self.spark, folder)
        return SearchIndex.create(self.spark, folder, o["text_fields"], o["ignore_case"], o["ignore_accent"])

    def save(self, name: str, structure: Any) -> None:
        """The rows of a structure's object in the place of the stored ones."""
        self.write(name, structure.df.select(*self.entry(name)["fields"]))

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(k for k, v in self._now().items() if kind in (None, v["kind"]))

    def __contains__(self, name: str) -> bool:
        return name in self._now()

    def read(self, name: str) -> DataFrame:
        entry = self.entry(name)
        schema = struct(entry["fields"])
        return self.spark.read.schema(schema).parquet(*entry["paths"]) if entry["paths"] else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame, sort: list[str] | None = None, partition: list[str] | None = None) -> None:
        """The structure's rows, checked against its fields. `sort` lays files out in ranges, for pruning by their statistics."""
        path = self._folder(name, df, sort, partition)
        self._change(lambda e: e[name].__setitem__("paths", [path]))

    def append(self, name: str, df: DataFrame, sort: list[str] | None = None) -> None:
        """More rows, in a folder of their own: what is there isn't read. vacuum() makes one folder of many."""
        path = self._folder(name, df, sort, None)
        self._change(lambda e: e[name].__setitem__("paths", [*e[name]["paths"], path]))

    def _folder(self, name: str, df: DataFrame, sort: list[str] | None, partition: list[str] | None) -> str:
        self._writable()
        entry = self.entry(name)
        out = conformed(df, entry["fields"])
        if sort:
            out = out.repartitionByRange(*sort).sortWithinPartitions(*sort)
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        writer = out.write.partitionBy(*partition) if partition else out.write
        writer.parquet(path)
        return path

    def drop(self, name: str) -> None:
        self.entry(name)
        self._change(lambda e: e.pop(name))

    def handle(self, name: str) -> Callable[[], DataFrame]:
        """Reads the structure whenever it is called; after a drop it refuses, even if the name is in use again."""
        mine = self.entry(name)["id"]

        def read() -> DataFrame:
            if name not in self._now() or self._now()[name]["id"] != mine:
                raise Dropped(name)
            return self.read(name)

        return read

    def migrate(self, name: str, fields: dict[str, str], transforms: dict[str, Column] | None = None, indexes: dict[str, Index] | None = None) -> None:
        """Field by field: its transform, else the old field, else its zero."""
        old = self.read(name)
        made = {k: (transforms or {}).get(k, F.col(k) if k in old.columns else None) for k in fields}
        new = old.select(*[c.alias(k) for k, c in made.items() if c is not None])
        with self.durable():
            entry = self._staged[name]
            entry["fields"] = fields
            if indexes is not None:
                entry["options"]["indexes"] = {k: [type(v).__name__, dict(v.__dict__)] for k, v in indexes.items()}
            self.write(name, new)

    def vacuum(self, partitions: int | None = None) -> None:
        """Every table written anew and compactly; folders that no manifest version keeps are removed, and old manifests."""
        with self.durable():
            for name, entry in list(self._staged.items()):
                if entry["paths"]:
                    df = self.read(name)
                    self.write(name, df.coalesce(partitions) if partitions else df)
        kept = {p.rsplit("/", 1)[1] for e in self.entries.values() for p in e["paths"]}
        for folder in self._fs.listStatus(self._path()):
            if folder.isDirectory() and not folder.getPath().getName().startswith("_"):
                for sub in self._fs.listStatus(folder.getPath()):
                    if sub.getPath().getName() not in kept:
                        self._fs.delete(sub.getPath(), True)
        for f in self._fs.listStatus(self._path("_manifests")):
            if f.getPath().getName() != f"{self.version:012d}.json":
                self._fs.delete(f.getPath(), False)

    def verify(self, references: list[tuple[str, str, str, str]] = ()) -> dict[str, Any]:
        """{'ok', 'issues'}: unique fields, and references (child, field, parent, key)."""
        issues = []
        for name in self.names("collection"):
            issues += [f"{name}.{r['field']} = {r['value']}: {r['n']} records" for r in self.collection(name).violations().toLocalIterator()]
        for child, field, parent, key in references:
            if n := dangling(self.read(child), field, self.read(parent), key).count():
                issues.append(f"{child}.{field}: {n} without a record in {parent}")
        return {"ok": not issues, "issues": issues}

    def stats(self) -> dict[str, Any]:
        return {name: {"kind": e["kind"], "rows": self.read(name).count(), "bytes": sum(int(self._fs.getContentSummary(self._jvm.org.apache.hadoop.fs.Path(p)).getLength()) for p in e["paths"])} for name, e in self._now().items()}
