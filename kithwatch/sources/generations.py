"""Tables that grow batch by batch in a folder and are folded into one copy now and then.

A batch writes a folder of its own, ``part-<batch>``. Folding writes all there is as one
folder, ``generation-<number>``. What counts is said by a manifest, a small file that is
written aside and renamed: a reader sees the folders of one manifest, so never a part and the
generation that holds it, nor half of either.

Whatever step a writer dies at, the manifest still names whole folders. A batch that the
manifest holds already is not written again, one that it does not hold replaces what its last try left.
Folding keeps the folders that the manifest before named, for readers that have planned
with it, and deletes all others. There is one writer at a time, as with a streaming query.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Manifest:
    """The folders that count, oldest first, and the last batch they hold."""

    number: int = 0
    generation: str | None = None
    parts: tuple[str, ...] = ()
    last: int = -1
    before: tuple[str, ...] = ()
    #: Columns of the tables, for readers that do not know them.
    schemas: Mapping[str, str] = field(default_factory=dict)

    def folders(self) -> tuple[str, ...]:
        return ((self.generation,) if self.generation else ()) + self.parts


class Generations:
    """``schemas`` names the tables; of those in ``latest`` only the newest folder's rows count.

    A reader may leave the schemas to the manifest, which must be there then.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str] | None = None, latest: Collection[str] = ()):
        self.spark, self.path, self.latest = spark, path, set(latest)
        self.schemas = dict(self.manifest().schemas if schemas is None else schemas)
        if not self.schemas:
            raise FileNotFoundError(f"no tables have been written to {path}")

    def manifest(self) -> Manifest:
        names = [name for name in self._names("manifest") if name.endswith(".json")]
        if not names:
            return Manifest()
        found = json.loads(self._load(f"manifest/{max(names)}"))
        return Manifest(**{**found, "parts": tuple(found["parts"]), "before": tuple(found["before"])})

    def read(self, table: str, manifest: Manifest | None = None) -> DataFrame:
        """All rows of a table in the folders of the (newest) manifest."""
        folders = (manifest or self.manifest()).folders()
        if table in self.latest:
            folders = folders[-1:]
        if not folders:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*(f"{self.path}/{folder}/{table}" for folder in folders))

    def append(self, batch: int, tables: Mapping[str, DataFrame]) -> Manifest:
        """Add the rows of a batch, unless they are there already."""
        now = self.manifest()
        if batch <= now.last:
            return now
        folder = f"part-{batch:012d}"
        self._write(folder, tables)
        return self._switch(replace(now, parts=(*now.parts, folder), last=batch, before=now.folders()))

    def fold(self, tables: Mapping[str, DataFrame]) -> Manifest:
        """Replace all there is by ``tables``, which say the same in one copy."""
        now = self.manifest()
        folder = f"generation-{now.number + 1:012d}"
        self._write(folder, tables)
        then = self._switch(replace(now, generation=folder, parts=(), before=now.folders()))
        self._sweep(then)
        return then

    def _write(self, folder: str, tables: Mapping[str, DataFrame]) -> None:
        if set(tables) != set(self.schemas):
            raise ValueError(f"tables {sorted(tables)} instead of {sorted(self.schemas)}")
        for name, table in tables.items():
            kinds = self.spark.createDataFrame([], self.schemas[name]).schema
            columns = [table[f.name].cast(f.dataType).alias(f.name) for f in kinds]
            table.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{folder}/{name}")

    def _switch(self, manifest: Manifest) -> Manifest:
        manifest = replace(manifest, number=manifest.number + 1, schemas=self.schemas)
        name = f"manifest/{manifest.number:012d}"
        self._save(f"{name}.tmp", json.dumps(asdict(manifest)))
        system, source = self._at(f"{name}.tmp")
        if not system.rename(source, self._at(f"{name}.json")[1]):
            raise OSError(f"{self.path}/{name}.json is there already: a second writer?")
        return manifest

    def _sweep(self, manifest: Manifest) -> None:
        """Delete folders that neither this manifest nor the one before names, and old manifests."""
        kept = {*manifest.folders(), *manifest.before, "manifest"}
        for name in self._names(""):
            if name not in kept:
                self._delete(name)
        for name in self._names("manifest"):
            if name < f"{manifest.number - 1:012d}":
                self._delete(f"manifest/{name}")

    def _at(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, folder: str) -> list[str]:
        system, target = self._at(folder)
        return [found.getPath().getName() for found in system.listStatus(target)] if system.exists(target) else []

    def _delete(self, name: str) -> None:
        system, target = self._at(name)
        system.delete(target, True)

    def _save(self, name: str, text: str) -> None:
        system, target = self._at(name)
        out = system.create(target, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _load(self, name: str) -> str:
        system, target = self._at(name)
        stream = system.open(target)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
