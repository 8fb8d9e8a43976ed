"""Selection: scan, filter, project, order and limit, as one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.analyze import Analyzer, analyze
from marlstone.plans.ast import SelectQuery
from marlstone.plans.compile import Compiler, wrapping_integers
from marlstone.problems import Errors, Problem, ProblemsError
from marlstone.types import Kind


class Planner:
    """Plans selections over tables: an object with columns_of(name) and scan(name)."""

    def __init__(self, spark: SparkSession, tables, strict: bool = True):
        self.spark, self.tables, self.strict = spark, tables, strict

    def plan(self, query: SelectQuery) -> DataFrame:
        """The result with columns c0, c1 and on; ProblemsError where analysis finds any.

        Boolean columns have no stored form, so selecting one fails, after the analysis. The projection stands
        below order and limit: every row of an ordered result is evaluated.
        """
        found = analyze(query, self.tables)
        if Kind.BOOL in (kinds := found.kinds):
            raise ProblemsError(Problem(f"{Errors.UNEXPECTED}: a column of type BOOL can't be stored", f"c{kinds.index(Kind.BOOL)}"))
        with wrapping_integers(self.spark):
            compiler = Compiler(Analyzer(self.tables).kind_of, self.strict)
            rows = self.tables.scan(found.table) if found.table is not None else self.spark.range(1).select()
            if query.where is not None:
                rows = rows.where(compiler.condition(query.where))
            out = rows.select(*[compiler.value(e).alias(f"c{i}") for i, e in enumerate(query.columns)])
            if query.order_by:
                out = out.orderBy(*[F.col(f"c{o.column_index}").asc() if o.ascending else F.col(f"c{o.column_index}").desc() for o in query.order_by])
            return out if query.limit is None else out.limit(query.limit)
