"""A DB-API 2.0 cursor over an Engine."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.errors import AnalysisException

from .engine import Engine
from .sql.lexer import SqlError

apilevel, threadsafety, paramstyle = "2.0", 1, "pyformat"


class Warning(Exception):  # noqa: A001
    """The names of exceptions and type objects are fixed by DB-API 2.0."""


class Error(Exception):
    pass


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class IntegrityError(DatabaseError):
    pass


class InternalError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


class NotSupportedError(DatabaseError):
    pass


class _Kind:
    """Equal to the type names of a description that belong to it."""

    def __init__(self, *names: str) -> None:
        self.names = names

    def __eq__(self, other: object) -> bool:
        return isinstance(other, str) and other.partition("(")[0] in self.names

    __hash__ = None


STRING, BINARY, DATETIME, ROWID = _Kind("string", "varchar", "char"), _Kind("binary"), _Kind("date", "timestamp", "timestamp_ntz"), _Kind()
NUMBER = _Kind("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def escaped(value: object) -> str:
    """A parameter as a literal of the dialect."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value) if value >= 0 else f"({value!r})"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise ProgrammingError(f"cannot pass {type(value).__name__}")


def connect(engine: Engine) -> Connection:
    return Connection(engine)


class Connection:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def cursor(self) -> Cursor:
        return Cursor(self.engine)

    def commit(self) -> None:
        """Statements take effect at once."""

    rollback = close = commit


class Cursor:
    """Rows come from the cluster partition by partition, as they are fetched; ``rowcount`` stays -1, as they are not counted."""

    arraysize = 100

    def __init__(self, engine: Engine) -> None:
        self.engine, self.rows = engine, iter(())
        self.description, self.rowcount = None, -1

    def execute(self, sql: str, params: dict | tuple | None = None) -> Cursor:
        if params:
            sql %= {k: escaped(v) for k, v in params.items()} if isinstance(params, dict) else tuple(map(escaped, params))
        try:
            found = self.engine.execute(sql)
        except NotImplementedError as e:
            raise NotSupportedError(str(e)) from e
        except (SqlError, KeyError, AnalysisException) as e:
            raise ProgrammingError(str(e)) from e
        self.rows = map(tuple, found.toLocalIterator()) if found is not None else iter(())
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in found.schema] if found is not None else None
        return self

    def executemany(self, sql: str, many: list) -> Cursor:
        """Runs the statement with each set of parameters; the rows are those of the last."""
        for params in many:
            self.execute(sql, params)
        return self

    def fetchone(self) -> tuple | None:
        return next(self.rows, None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return list(islice(self.rows, self.arraysize if size is None else size))

    def fetchall(self) -> list[tuple]:
        return list(self.rows)

    def __iter__(self) -> Iterator[tuple]:
        return self.rows

    def setinputsizes(self, sizes: object) -> None:
        """Nothing to prepare."""

    def setoutputsize(self, size: int, column: int | None = None) -> None:
        """Nothing to prepare."""

    def close(self) -> None:
        self.rows = iter(())
