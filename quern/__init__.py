"""quern: PostgreSQL-flavoured SQL and DataFrame operators on PySpark."""

from .engine import Engine, execute
from .sql import parse, tokenize

__all__ = ["Engine", "execute", "parse", "tokenize"]
