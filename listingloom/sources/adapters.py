"""Source adapters found in a folder: each file is a plugin with a manifest, a source for batches and streams.

A plugin file has ``create_adapter(settings)``. The adapter that it returns has a ``manifest`` (name, version, schema and what else it tells), and
reads its source by partition and offset:

* ``partitions()`` names the parts of the source that are read apart from one another (channels, pages, shards);
* ``latest(partition)`` is the offset behind the last row that is there now, from 0 up;
* ``read(partition, start, end)`` gives the rows from offset ``start`` to before ``end`` as tuples in the order of the schema,
  the same ones each time it is asked.
"""

from __future__ import annotations

import hashlib
import importlib.util
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Rows of one input partition of a batch or micro-batch.
CHUNK_ROWS = 100_000
#: Fields that a manifest must have, each a text that is not empty.
REQUIRED = ("name", "version", "schema")


@dataclass
class Slice(InputPartition):
    """Rows of one of the source's partitions between two offsets."""

    partition: str
    start: int
    end: int


def slices(start: dict[str, int], end: dict[str, int], rows: int = CHUNK_ROWS) -> list[Slice]:
    """What is new between two offsets of all partitions; a partition that only ``end`` has begins at 0."""
    out = []
    for name in sorted(end):
        at = start.get(name, 0)
        while at < end[name]:
            out.append(Slice(name, at, min(at + rows, end[name])))
            at = out[-1].end
    return out


class _Slices:
    def __init__(self, adapter: object):
        self.adapter = adapter

    def now(self) -> dict[str, int]:
        return {str(p): int(self.adapter.latest(p)) for p in self.adapter.partitions()}

    def read(self, part: Slice) -> Iterator[tuple]:
        yield from self.adapter.read(part.partition, part.start, part.end)


class BatchReader(_Slices, DataSourceReader):
    def partitions(self) -> list[Slice]:
        return slices({}, self.now())


class StreamReader(_Slices, DataSourceStreamReader):
    """Offsets are a mapping of all partitions; they are in the query's checkpoint, so a restart goes on where the last batch ended."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.now()

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return slices(start, end)

    def commit(self, end: dict) -> None:
        """Told to the adapter, if it wants to know."""
        if hasattr(self.adapter, "commit"):
            self.adapter.commit(end)


def source_of(adapter: object) -> type[DataSource]:
    """The data source class of one adapter."""
    manifest = dict(adapter.manifest)

    class AdapterSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return manifest["name"]

        def schema(self) -> str:
            return manifest["schema"]

        def reader(self, schema) -> BatchReader:
            return BatchReader(adapter)

        def streamReader(self, schema) -> StreamReader:
            return StreamReader(adapter)

    return AdapterSource


@dataclass(frozen=True)
class Loaded:
    """A plugin's state after a reload: loaded or failed, with the error of the last try; a loaded one with an error is the version before."""

    name: str
    path: str
    state: str
    manifest: dict | None = None
    error: str | None = None
    file_hash: str | None = None


@dataclass
class AdapterRegistry:
    """The plugins of a folder. A file that fails to load is reported and the others load; one that was loaded before stays as it was."""

    folder: str
    settings: dict = field(default_factory=dict)
    adapters: dict[str, tuple[object, Loaded]] = field(default_factory=dict)

    def reload(self, spark: SparkSession) -> list[Loaded]:
        """Loads every ``*.py`` but those that begin with an underscore and registers it with the session, in order of name."""
        found: dict[str, tuple[object, Loaded]] = {}
        report = []
        for path in sorted(Path(self.folder).glob("[!_]*.py")):
            try:
                adapter, told = self._load(path)
                spark.dataSource.register(source_of(adapter))
                found[path.stem] = adapter, told
            except Exception as e:
                before = self.adapters.get(path.stem)
                error = str(e) or type(e).__name__
                told = Loaded(path.stem, str(path), "failed", error=error)
                if before is not None:
                    told = Loaded(path.stem, str(path), "loaded", before[1].manifest, error, before[1].file_hash)
                    found[path.stem] = before[0], told
            report.append(told)
        self.adapters = found
        return report

    def failures(self) -> list[Loaded]:
        return [told for _, told in self.adapters.values() if told.error is not None]

    def _load(self, path: Path) -> tuple[object, Loaded]:
        module = _module(path)
        create = getattr(module, "create_adapter", None)
        if not callable(create):
            raise AttributeError(f"{path.name} has no create_adapter(settings)")
        adapter = create(self.settings)
        manifest = check_manifest(getattr(adapter, "manifest", None), path.stem)
        for name in ("partitions", "latest", "read"):
            if not callable(getattr(adapter, name, None)):
                raise AttributeError(f"the adapter of {path.name} has no method {name}")
        cloudpickle.register_pickle_by_value(module)  # executors don't have the folder
        return adapter, Loaded(path.stem, str(path), "loaded", manifest, None, hashlib.sha256(path.read_bytes()).hexdigest())


def _module(path: Path) -> ModuleType:
    name = f"listingloom_adapters_{path.stem}"
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    try:
        spec.loader.exec_module(module)
    except BaseException:
        del sys.modules[name]
        raise
    return module


def check_manifest(manifest: object, stem: str) -> dict:
    """The manifest as a dictionary; ValueError where a field is missing, the name is not the file's or it can't be written as JSON."""
    if not isinstance(manifest, dict):
        raise ValueError("an adapter must have a manifest")
    for name in REQUIRED:
        if not isinstance(manifest.get(name), str) or not manifest[name].strip():
            raise ValueError(f"the manifest has no {name}")
    if not re.fullmatch(r"[a-z][a-z0-9_]{1,63}", manifest["name"]):
        raise ValueError(f"{manifest['name']!r} is no name for an adapter")
    if manifest["name"] != stem:
        raise ValueError(f"manifest name {manifest['name']!r} must be the file's, {stem!r}")
    json.dumps(manifest)
    return dict(manifest)
