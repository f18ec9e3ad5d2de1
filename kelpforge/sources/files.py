"""Scenario files of either format as a data source, a file a task."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

from kelpforge.sources.scenarios import SCENARIO

FORMATS = {".json": "json", ".yaml": "yaml", ".yml": "yaml"}
_KINDS = {StringType: str, DoubleType: (int, float), IntegerType: int, LongType: int, BooleanType: bool}


def checked(value: Any, kind: DataType, where: str) -> Any:
    """The value as Spark takes it; what does not fit the kind is an error that names its place. Fields that are missing are null, fields that no one knows are left out."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        if not isinstance(value, dict):
            raise ValueError(f"{where} must be a mapping, not {type(value).__name__}")
        return tuple(checked(value.get(f.name), f.dataType, f"{where}.{f.name}" if where else f.name) for f in kind.fields)
    if isinstance(kind, ArrayType):
        if not isinstance(value, list):
            raise ValueError(f"{where} must be a list, not {type(value).__name__}")
        return [checked(v, kind.elementType, f"{where}[{i}]") for i, v in enumerate(value)]
    if not isinstance(value, _KINDS[type(kind)]) or isinstance(value, bool) and not isinstance(kind, BooleanType):
        raise ValueError(f"{where} must be {kind.simpleString()}, not {value!r}")
    return float(value) if isinstance(kind, DoubleType) else value


def parsed(text: str, format: str) -> Any:
    if format == "json":
        return json.loads(text)
    import yaml  # needed for files of that format only

    return yaml.load(text, Loader=_loader())


@lru_cache(None)
def _loader() -> type:
    """Safe, and numbers with an exponent are numbers as in JSON and YAML 1.2 (1E7, 1.5e7), which YAML 1.1 takes as text unless they have a point and a sign."""
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)[eE][-+]?[0-9]+$"), list("-+.0123456789"))
    return Loader


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class OneFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ScenarioReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.kind, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        """A task for each file: the one named, or all of known formats in the folder named and those below it."""
        from pyarrow import fs

        path = self.options.get("path")
        if not path:
            raise ValueError("no path is given")
        store, inside = _store(path)
        info = store.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no scenario at {path}")
        if info.type == fs.FileType.File:
            return [OneFile(path)]
        head = path.rstrip("/")
        found = [f.path for f in store.get_file_info(fs.FileSelector(inside, recursive=True)) if f.type == fs.FileType.File and self._format(f.path)]
        return [OneFile(head + p[len(inside.rstrip("/")) :]) for p in sorted(found)]

    def _format(self, path: str) -> str | None:
        name = path.rsplit("/", 1)[-1]
        if name.startswith(("_", ".")):
            return None
        return self.options.get("as") or FORMATS.get(f".{name.rsplit('.', 1)[-1].lower()}" if "." in name else "")

    def read(self, partition: OneFile | None) -> Iterator[tuple]:
        if partition is None:  # Spark reads a source without partitions once
            return
        store, inside = _store(partition.path)
        try:
            with store.open_input_stream(inside) as stream:
                text = stream.read().decode("utf-8")
            value = parsed(text, self._format(partition.path) or "json")
            if value is None:
                raise ValueError("the file is empty")
            yield checked(value, self.kind, "")
        except Exception as e:
            raise ValueError(f"malformed scenario {partition.path}: {e}") from e


class ScenarioSource(DataSource):
    """spark.read.format("scenario").load(path): YAML and JSON files. Option `as` (json, yaml) holds for all files, whatever their names end with."""

    @classmethod
    def name(cls) -> str:
        return "scenario"

    def schema(self) -> str:
        return SCENARIO

    def reader(self, schema: StructType) -> DataSourceReader:
        return ScenarioReader(schema, dict(self.options))


def scenario_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A row per scenario file at the path (a file or a folder), in the schema of `scenarios`. A missing path, or a file that cannot be read as one, fails with its name."""
    spark.dataSource.register(ScenarioSource)
    return spark.read.format("scenario").options(**options).load(path)
