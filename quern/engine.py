"""The session: named tables, functions, and the execution of statements."""

from __future__ import annotations

import inspect
import operator
import json
import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import read_table, resolved, write_table
from .sql import nodes as n
from .sql.lexer import SqlError
from .sql.parser import parse
from .sql.render import Renderer, quote

SHOWN = {"transaction isolation level": "read only", "standard_conforming_strings": "on"}
PG_NAMESPACE = [("public", 0, None), ("pg_catalog", 0, None), ("information_schema", 0, None)]
FOLDED = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod}


def constant(e: n.Node) -> object:
    """The value of an argument of a table function: a literal, with signs and arithmetic."""
    if isinstance(e, n.Literal):
        return e.value
    if isinstance(e, n.Unary) and e.op in ("-", "+"):
        return -constant(e.arg) if e.op == "-" else constant(e.arg)
    if isinstance(e, n.Binary) and e.op in FOLDED:
        return FOLDED[e.op](constant(e.left), constant(e.right))
    raise SqlError("arguments of a table function have to be constants")


def repeats(df: DataFrame) -> bool:
    """Each run gives the same rows: files or a range, projected and filtered by functions without chance."""
    if df.isStreaming or not hasattr(df, "_jdf"):
        return False
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() not in ("LogicalRelation", "LocalRelation", "Range", "Project", "Filter", "SubqueryAlias") or not plan.deterministic():
            return False
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    return True


class Engine:
    """Runs statements against a scope of DataFrames (pandas frames are converted).

    ``default_order``: direction of ORDER BY where none is given. ``safe_divide``: division by zero gives
    null instead of an error. ``materialize``: CREATE TABLE AS caches its rows. ``case_sensitive``: names of
    columns differ by case.
    """

    def __init__(self, spark: SparkSession | None = None, scope: dict | None = None, basepath: str = ".", default_order: str = "asc", safe_divide: bool = False, materialize: bool = False, case_sensitive: bool = False) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.scope: dict[str, DataFrame | pd.DataFrame] = {}
        self.case_sensitive = case_sensitive
        self.basepath, self.default_order, self.safe_divide, self.materialize = basepath, default_order, safe_divide, materialize
        self.table_functions: dict[str, Callable] = {}
        self.functions: dict[str, str] = {}
        self.laterals: dict[str, str] = {}
        self.update(**(scope or {}))

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None, **options) -> Engine:
        """A session from a JSON file whose ``setup`` lists statements to run; their paths are relative to the file."""
        with open(path, encoding="utf-8") as f:
            setup = json.load(f).get("setup", [])
        made = cls(spark, basepath=os.path.dirname(os.path.abspath(path)), **options)
        for statement in setup:
            made.execute(statement)
        return made

    def table_names(self) -> list[str]:
        return sorted(self.scope)

    def update(self, **tables) -> None:
        """Adds tables by name; a pandas frame goes to Spark when a statement first names it."""
        self.scope.update(tables)

    def add_function(self, name: str, f: Callable, returns: str = "string", by_row: bool = False) -> None:
        """A scalar function of whole columns (Series in Arrow batches), a pandas_udf, or with ``by_row`` one of single values."""
        if not by_row and not hasattr(f, "returnType"):
            plain = f

            def whole(*columns: pd.Series) -> pd.Series:
                return plain(*columns)

            f = F.pandas_udf(whole, returns)
        self._register(name, f, returns if by_row else None)

    def add_aggregate(self, name: str, f: Callable, returns: str = "double") -> None:
        """An aggregate: a function of a group's columns (Series) that gives one value. Each group has to fit in a worker."""

        def of_group(*columns: pd.Series) -> float:
            return f(*columns)

        self._register(name, F.pandas_udf(of_group, returns))

    def _register(self, name: str, f: Callable, returns: str | None = None) -> None:
        own = f"quern_{uuid.uuid4().hex}"
        self.spark.udf.register(own, f, returns)
        self.functions[name.lower()] = own

    def add_table_function(self, name: str, f: Callable) -> None:
        """A function of literals that gives a frame; it runs when the statement is executed."""
        self.table_functions[name.lower()] = f

    def add_lateral_function(self, name: str, handler, returns: str | None = None) -> None:
        """A table function of row values: a UDTF class, or a generator function with its schema in ``returns``."""
        from pyspark.sql.functions import udtf

        if returns is not None:
            if inspect.isclass(handler):
                kind = handler
            else:
                kind = type(name, (), {"eval": staticmethod(handler)})
            handler = udtf(kind, returnType=returns)
        own = f"quern_{uuid.uuid4().hex}"
        self.spark.udtf.register(own, handler)
        self.laterals[name.lower()] = own

    def compute(self, df: DataFrame) -> pd.DataFrame:
        return df.toPandas()

    def execute(self, sql: str, basepath: str | None = None) -> DataFrame | None:
        """The result of a query or SHOW as a lazy DataFrame; None for other statements."""
        tree, base = parse(sql), basepath or self.basepath
        if isinstance(tree, n.Query):
            return self.run(tree, base)
        if isinstance(tree, n.Show):
            if tree.option not in SHOWN:
                raise NotImplementedError(f"SHOW {tree.option}")
            return self.spark.createDataFrame([(SHOWN[tree.option],)], "value string")
        if isinstance(tree, n.CopyFrom):
            self.scope[".".join(tree.table)] = read_table(self.spark, resolved(tree.path, base), tree.options)
        elif isinstance(tree, n.CopyTo):
            write_table(self.named(tree.table), resolved(tree.path, base), tree.options)
        elif isinstance(tree, n.CreateAs):
            made = self.run(tree.query, base)
            self.scope[".".join(tree.table)] = made.cache() if self.materialize else made
        elif isinstance(tree, n.Drop):
            for parts in tree.tables:
                if not tree.missing_ok:
                    self.named(parts)
                self.scope.pop(".".join(parts), None)
        return None

    def named(self, parts: tuple[str, ...]) -> DataFrame:
        name = ".".join(parts)
        if name in self.scope:
            if isinstance(self.scope[name], pd.DataFrame):
                self.scope[name] = self.spark.createDataFrame(self.scope[name])
            return self.scope[name]
        if parts[-1] == "pg_namespace":
            return self.spark.createDataFrame(PG_NAMESPACE, "nspname string, nspowner int, nspacl string")
        raise KeyError(f"table {name!r} not found")

    def render(self, tree: n.Query, basepath: str | None = None, split: bool = True) -> tuple[str, list[str], bool]:
        """Spark SQL of a query, the temporary views that it reads, and whether something in it was split (see Renderer)."""
        views: dict[int, str] = {}

        def view(df: DataFrame) -> str:
            if id(df) not in views:
                views[id(df)] = f"quern_{uuid.uuid4().hex}"
                df.createOrReplaceTempView(views[id(df)])
            return quote(views[id(df)])

        held: list[DataFrame] = []

        def table(parts: tuple[str, ...]) -> str:
            held.append(self.named(parts))
            return view(held[-1])

        def function(call: n.Call, r: Renderer) -> str | None:
            if call.name == "copy_from":
                path, *rest = map(constant, call.args)
                held.append(read_table(self.spark, resolved(path, basepath or self.basepath), dict(zip(rest[::2], rest[1::2], strict=True))))
                return view(held[-1])
            if call.name in self.table_functions:
                made = self.table_functions[call.name](*map(constant, call.args))
                held.append(self.spark.createDataFrame(made) if isinstance(made, pd.DataFrame) else made)
                return view(held[-1])
            if call.name in self.laterals:
                return f"{self.laterals[call.name]}({', '.join(map(r.expr, call.args))})"
            return None

        renderer = Renderer(table, function, self.default_order, self.safe_divide, split, lambda parts: repeats(self.named(parts)))
        call = renderer._call

        def own(e: n.Call) -> str:
            if e.name in self.functions:
                where = f" FILTER (WHERE {renderer.expr(e.where)})" if e.where is not None else ""
                return f"{self.functions[e.name]}({', '.join(map(renderer.expr, e.args))}){where}"
            return call(e)

        renderer._call = own
        return renderer.query(tree), list(views.values()), renderer.was_split

    def run(self, tree: n.Query, basepath: str | None = None, split: bool = True) -> DataFrame:
        sql, views, was_split = self.render(tree, basepath, split)
        setting, before = "spark.sql.caseSensitive", self.spark.conf.get("spark.sql.caseSensitive")
        try:
            if self.case_sensitive:
                self.spark.conf.set(setting, "true")
            return self.spark.sql(sql)
        except AnalysisException:
            # for example, Spark takes fewer correlated forms of EXISTS than of NOT IN
            if not was_split:
                raise
            return self.run(tree, basepath, False)
        finally:
            self.spark.conf.set(setting, before)
            for v in views:
                self.spark.catalog.dropTempView(v)


def execute(sql: str, scope: dict | None = None, spark: SparkSession | None = None, basepath: str = ".", **options) -> DataFrame | None:
    """Runs one statement; without a scope, the caller's DataFrames by their variable names."""
    if scope is None:
        frame = inspect.currentframe().f_back
        scope = {k: v for k, v in {**frame.f_globals, **frame.f_locals}.items() if isinstance(v, (DataFrame, pd.DataFrame))}
    return Engine(spark, scope, basepath, **options).execute(sql)
