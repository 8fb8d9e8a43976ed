"""The catalog: tables with declared columns, each a list of Parquet folders, kept in a JSON file.

A file list is replaced as a whole, so readers work on the list they began with. The catalog's file is written
beside the old one and renamed. All paths are Spark's, so tables can lie in any store that executors share.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans.ast import fields, items, text
from marlstone.problems import DecodeError, Errors, Problem, ProblemsError
from marlstone.storage import Storage
from marlstone.types import ColumnDef, Kind, struct_of


def stored_kind(json: object) -> Kind:
    if json not in (Kind.INT64.value, Kind.VARCHAR.value):
        raise DecodeError(f"columns are INT64 or VARCHAR, not {json!r}")
    return Kind(json)


def column_def(json: object) -> ColumnDef:
    found = fields(json, {"name": text, "type": stored_kind})
    return found["name"], found["type"]


@dataclass(frozen=True)
class Table:
    id: str
    name: str
    columns: tuple[ColumnDef, ...]
    files: tuple[str, ...] = field(default=())

    def to_json(self) -> dict:
        return {"name": self.name, "id": self.id, "columns": [{"name": n, "type": k.value} for n, k in self.columns], "files": list(self.files)}

    def schema_json(self) -> dict:
        return {"name": self.name, "columns": [{"name": n, "type": k.value} for n, k in self.columns]}


class Catalog:
    """path: the catalog's file; table_folder: where tables' files are."""

    def __init__(self, spark: SparkSession, path: str, table_folder: str):
        self.spark, self.path, self.table_folder = spark, path, table_folder
        self._tables: dict[str, Table] = {}
        self._lock, self._storage = threading.RLock(), Storage(spark)
        self._storage.make_folder(table_folder)
        self._load()

    def _load(self) -> None:
        content = self._storage.read_text(self.path) or ""
        for t in json.loads(content)["tables"] if content.strip() else []:
            self._tables[t["id"]] = Table(t["id"], t["name"], tuple(column_def(c) for c in t["columns"]), tuple(t["files"]))

    def save(self) -> None:
        with self._lock:
            self._storage.write_text(self.path, json.dumps({"tables": [t.to_json() for t in self._tables.values()]}))

    def create(self, name: str, columns: list[ColumnDef]) -> str:
        """The new table's id; ProblemsError for a name that is taken or a column given twice."""
        with self._lock:
            if (other := self.by_name(name)) is not None:
                raise ProblemsError(Problem(Errors.SCHEMA, f"{name} is the name of table {other.id}"))
            names = [n for n, _ in columns]
            if twice := next((n for i, n in enumerate(names) if n in names[:i]), None):
                raise ProblemsError(Problem(Errors.SCHEMA, f"column {twice} is given twice"))
            table = Table(str(uuid.uuid4()), name, tuple(columns))
            self._tables[table.id] = table
            self.save()
            return table.id

    def drop(self, table_id: str) -> None:
        """Forget a table and delete its files; an unknown id is nothing."""
        with self._lock:
            table = self._tables.pop(table_id, None)
            self.save()
        for name in table.files if table else ():
            self._storage.remove(self._file(name))

    def _file(self, name: str) -> str:
        return f"{self.table_folder.rstrip('/')}/{name}"

    def all(self) -> list[Table]:
        return list(self._tables.values())

    def by_id(self, table_id: str) -> Table | None:
        return self._tables.get(table_id)

    def by_name(self, name: str) -> Table | None:
        return next((t for t in self._tables.values() if t.name == name), None)

    def append(self, table_id: str, rows: DataFrame) -> None:
        """Write rows as a new file of the table; it counts only once it is whole, and newest come first."""
        name = uuid.uuid4().hex
        path = self._file(name)
        try:
            rows.write.parquet(path)
        except BaseException:
            self._storage.remove(path)
            raise
        with self._lock:
            table = self._tables[table_id]
            self._tables[table_id] = replace(table, files=(name, *table.files))
            self.save()

    def columns_of(self, table: str) -> list[ColumnDef] | None:
        found = self.by_name(table)
        return None if found is None else list(found.columns)

    def scan(self, table: str) -> DataFrame:
        found = self.by_name(table)
        schema = struct_of(list(found.columns))
        if not found.files or not found.columns:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._file(f) for f in found.files])
