"""The query service: tables, queries with their states, and results.

Queries run one at a time, in the order they came, on a thread of their own. A result is written as Parquet by the
executors; the driver streams it in chunks when it is fetched, never holding more than a chunk.
"""

from __future__ import annotations

import os
import queue
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import __version__
from marlstone.catalog import Catalog, column_def
from marlstone.operators.select import Planner
from marlstone.plans.ast import CopyQuery, SelectQuery, boolean, definition_json, fields, integer, items, query_definition, text
from marlstone.problems import Errors, Problem, ProblemsError, found_in
from marlstone.sources.csv_copy import read_rows
from marlstone.storage import Storage, joined
from marlstone.streaming.chunks import CHUNK_BYTES, chunks

INTERFACE_VERSION = "1.0.1"
AUTHOR = "the marlstone authors"
_ORDER = "__order"


class Status(Enum):
    CREATED = "CREATED"
    PLANNING = "PLANNING"
    RUNNING = "RUNNING"
    COMPLETED = "COMPLETED"
    FAILED = "FAILED"


@dataclass
class Task:
    id: str
    definition: SelectQuery | CopyQuery
    status: Status = Status.CREATED
    result: str | None = None  # folder of the result's file; "" for a result without columns
    ordered: bool = False
    problems: list[Problem] | None = None

    @property
    def done(self) -> bool:
        return self.status in (Status.COMPLETED, Status.FAILED)


@dataclass(frozen=True)
class Settings:
    table_folder: str
    result_folder: str
    catalog_path: str
    data_folder: str
    chunk_bytes: int = CHUNK_BYTES
    strict: bool = True
    copy_scatter: bool = False
    #: Whether quoted fields of CSV files may have line breaks; without them large files are split among tasks.
    copy_multi_line: bool = True

    @classmethod
    def from_environment(cls, environment=os.environ) -> "Settings":
        """TABLE_DIRECTORY, RESULT_DIRECTORY, METASTORE_PATH and DATA_DIRECTORY are required; BUFFER_SIZE is not."""
        names = ("TABLE_DIRECTORY", "RESULT_DIRECTORY", "METASTORE_PATH", "DATA_DIRECTORY")
        if missing := [n for n in names if n not in environment]:
            raise KeyError(f"not set: {', '.join(missing)}")
        return cls(*[environment[n] for n in names], chunk_bytes=int(environment.get("BUFFER_SIZE", CHUNK_BYTES)))


class Service:
    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self._storage = Storage(spark)
        self._storage.make_folder(settings.result_folder)
        self.catalog = Catalog(spark, settings.catalog_path, settings.table_folder)
        self._tasks: dict[str, Task] = {}
        self._waiting: queue.Queue[Task | None] = queue.Queue()
        self._began = time.time()
        self._worker = threading.Thread(target=self._work, name="marlstone-queries", daemon=True)
        self._worker.start()

    # Tables

    def create_table(self, json: object) -> str:
        found = fields(json, {"name": text, "columns": items(column_def)})
        return self.catalog.create(found["name"], list(found["columns"]))

    def list_tables(self) -> list[dict]:
        return [{"tableId": t.id, "name": t.name} for t in self.catalog.all()]

    # Queries

    def submit(self, json: object) -> str:
        """Take in {"queryDefinition": ...}; the query's id."""
        task = Task(str(uuid.uuid4()), fields(json, {"queryDefinition": query_definition})["queryDefinition"])
        self._tasks[task.id] = task
        self._waiting.put(task)
        return task.id

    def task(self, query_id: str) -> Task | None:
        return self._tasks.get(query_id)

    def list_queries(self) -> list[dict]:
        return [{"queryId": t.id, "status": t.status.value} for t in list(self._tasks.values())]

    def describe_query(self, query_id: str) -> dict | None:
        task = self.task(query_id)
        if task is None:
            return None
        out: dict = {"queryId": task.id, "status": task.status.value}
        if task.done:
            out["isResultAvailable"] = task.result is not None
        if task.status is Status.COMPLETED:
            out["queryDefinition"] = definition_json(task.definition)
        return out

    def problems(self, query_id: str) -> list[Problem] | None:
        task = self.task(query_id)
        return task.problems if task and task.status is Status.FAILED else None

    def wait(self, query_id: str, seconds: float = 300) -> Task:
        """The task once it is done."""
        end = time.time() + seconds
        while not (task := self._tasks[query_id]).done:
            if time.time() > end:
                raise TimeoutError(query_id)
            time.sleep(0.01)
        return task

    def system_info(self) -> dict:
        return {"interfaceVersion": INTERFACE_VERSION, "version": __version__, "author": AUTHOR, "uptime": int(time.time() - self._began)}

    # Results

    def result(self, query_id: str, json: object = None) -> Iterator[dict] | None:
        """Chunks of a result, or None without one; takes {"rowLimit"?, "flushResult"?}. Flushed results go once they were read."""
        options = fields({} if json is None else json, {}, {"rowLimit": integer, "flushResult": boolean})
        task = self.task(query_id)
        if task is None or task.status is not Status.COMPLETED or task.result is None:
            return None
        return self._stream(task, options.get("rowLimit"), options.get("flushResult", False))

    def _stream(self, task: Task, limit: int | None, flush: bool) -> Iterator[dict]:
        try:
            if task.result:
                df = self.spark.read.parquet(task.result)
                if task.ordered:
                    df = df.orderBy(_ORDER).drop(_ORDER)
                if limit is not None:
                    df = df.limit(max(0, limit))
                yield from chunks((tuple(r) for r in df.toLocalIterator(prefetchPartitions=True)), self.settings.chunk_bytes)
        finally:
            if flush:
                self.flush(task.id)

    def flush(self, query_id: str) -> None:
        """Drop a result and what is known of its query."""
        task = self._tasks.pop(query_id, None)
        if task and task.result:
            self._storage.remove(task.result)

    def stop(self) -> None:
        """Finish the query that runs, drop all results and save the catalog."""
        self._waiting.put(None)
        self._worker.join()
        for query_id in list(self._tasks):
            self.flush(query_id)
        self.catalog.save()

    # The worker

    def _work(self) -> None:
        while (task := self._waiting.get()) is not None:
            task.status = Status.PLANNING
            try:
                run = self._copy if isinstance(task.definition, CopyQuery) else self._select
                run(task, task.definition)
                task.status = Status.COMPLETED
            except Exception as error:
                task.problems = found_in(error)
                task.status = Status.FAILED

    def _select(self, task: Task, query: SelectQuery) -> None:
        planned = Planner(self.spark, self.catalog, self.settings.strict).plan(query)
        task.status = Status.RUNNING
        if not query.columns:
            planned.foreach(lambda row: None)  # its condition can still fail
            task.result = ""
            return
        path = joined(self.settings.result_folder, task.id)
        task.ordered = bool(query.order_by)
        try:
            self._numbered(planned, task.ordered).write.parquet(path)
        except BaseException:
            self._storage.remove(path)
            raise
        task.result = path

    @staticmethod
    def _numbered(df: DataFrame, ordered: bool) -> DataFrame:
        """Partitions of an ordered result follow each other, so ids that grow through them keep the order."""
        return df.withColumn(_ORDER, F.monotonically_increasing_id()) if ordered else df

    def _copy(self, task: Task, query: CopyQuery) -> None:
        path = joined(self.settings.data_folder, query.source_filepath)
        if not self._storage.is_file(path):
            raise ProblemsError(Problem(Errors.INPUT_FILE, f"{query.source_filepath}, as {path}"))
        table = self.catalog.by_name(query.destination_table_name)
        if table is None:
            raise ProblemsError(Problem(Errors.DESTINATION_TABLE, query.destination_table_name))
        task.status = Status.RUNNING
        rows = read_rows(self.spark, path, table.columns, query.has_header, query.destination_columns, self.settings.copy_scatter, self.settings.copy_multi_line)
        self.catalog.append(table.id, rows)
