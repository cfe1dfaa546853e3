"""The SQL dialect: lexer, parser and renderer to Spark SQL."""

from .lexer import tokenize
from .parser import parse

__all__ = ["parse", "tokenize"]
