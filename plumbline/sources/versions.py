"""Tables in versions: parts are written to new folders and one small manifest, made last, names those that count.

A table is a set of parts, one for each value of a column (a run, a bucket). A commit writes the
parts that change, for all tables in one folder each, and then the manifest of the next number, which
names them and every part that stays. Readers take the newest manifest that is whole, so they see all of a
commit or nothing; what a crash leaves are folders that no manifest names. Of two commits at
once one finds its number taken and fails. A commit that is repeated writes the same rows again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Rows made from what the commit has written already.
Derived = Callable[[Callable[[str], DataFrame]], DataFrame]


class Conflict(RuntimeError):
    """Another commit has taken the number."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def _names(self, *names: str) -> list[str]:
        at = self._path(*names)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of the manifests, whole or not."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or the newest that is whole; an empty one before the first commit."""
        for n in reversed(self.versions()) if version is None else [version]:
            stream = self._fs.open(self._path("manifests", f"{n:012d}.json"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return json.loads(text)
            except ValueError:
                if version is not None:
                    raise
        return {"version": 0, "tables": {}, "info": {}}

    def has(self, table: str) -> bool:
        return table in self.manifest()["tables"]

    def read(self, table: str, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """A table, or those of its parts whose column has one of the values."""
        known = self.manifest(version)["tables"][table]
        return self._rows(table, known, [p for value, p in known["parts"].items() if parts is None or value in parts])

    def _rows(self, table: str, known: dict, paths: list[str]) -> DataFrame:
        schema, by = T.StructType.fromJson(known["schema"]), known["by"]
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*[f for f in schema if f.name != by], T.StructField("commit", T.StringType()), schema[by]])
        df = self.spark.read.schema(whole).option("basePath", f"{self.root}/data/{table}").parquet(*[f"{self.root}/data/{table}/{p}" for p in paths])
        return df.select(*schema.names)

    def commit(self, tables: dict[str, tuple[str, DataFrame | Derived]], gone: dict[str, list[str]] | None = None, info: dict | None = None) -> int:
        """Replace the parts that the rows of tables (name: (column of its parts, rows)) belong to, take away gone ones; the new version's number.

        Part values are texts and not null; a part that should become empty is named in gone. Rows may be
        a function of the rows that this commit has written before, by name. info is put over the version's before.
        """
        old = self.manifest()
        number = max(self.versions(), default=0) + 1
        new = {name: {**t, "parts": dict(t["parts"])} for name, t in old["tables"].items()}
        for name, values in (gone or {}).items():
            for v in values:
                new.get(name, {"parts": {}})["parts"].pop(v, None)
        written: dict[str, DataFrame] = {}
        for name, (by, made) in tables.items():
            df = made(written.__getitem__) if callable(made) else made
            folder = f"commit={number}-{uuid.uuid4().hex[:12]}"
            df.hint("rebalance", by).write.partitionBy(by).parquet(f"{self.root}/data/{name}/{folder}")
            values = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
            parts = {values.unescapePathName(n.split("=", 1)[1]): f"{folder}/{n}" for n in self._names("data", name, folder) if n.startswith(f"{by}=")}
            kept = new.get(name, {}).get("parts", {})
            new[name] = {"by": by, "schema": df.schema.jsonValue(), "parts": {**kept, **parts}}
            written[name] = self._rows(name, new[name], [parts[v] for v in sorted(parts)])
        self._put(number, {"version": number, "tables": new, "info": {**old["info"], **(info or {})}})
        return number

    def _put(self, number: int, manifest: dict) -> None:
        try:
            out = self._fs.create(self._path("manifests", f"{number:012d}.json"), False)
        except Py4JJavaError as e:
            raise Conflict(f"version {number} of {self.root} is there") from e
        try:
            out.write(json.dumps(manifest, sort_keys=True).encode())
        finally:
            out.close()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests and folders that the newest keep versions do not name; what is gone. Not while a commit runs."""
        numbers = self.versions()
        stay = {p.split("/")[0] for n in numbers[-keep:] for t in self.manifest(n)["tables"].values() for p in t["parts"].values()}
        dead = [("manifests", f"{n:012d}.json") for n in numbers[:-keep]]
        dead += [("data", t, f) for t in self._names("data") for f in self._names("data", t) if f not in stay]
        for names in dead:
            self._fs.delete(self._path(*names), True)
        return ["/".join(names) for names in dead]
