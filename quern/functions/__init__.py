"""Functions and type names of the dialect, as Spark SQL."""

from __future__ import annotations

#: PostgreSQL type names and Spark's.
TYPES = {
    "text": "STRING", "varchar": "STRING", "char": "STRING", "character": "STRING", "bpchar": "STRING", "int": "INT", "int2": "SMALLINT", "int4": "INT", "int8": "BIGINT",
    "integer": "INT", "bigint": "BIGINT", "smallint": "SMALLINT", "float4": "FLOAT", "real": "FLOAT", "float8": "DOUBLE", "double": "DOUBLE", "float": "DOUBLE", "bool": "BOOLEAN",
    "boolean": "BOOLEAN", "numeric": "DECIMAL", "decimal": "DECIMAL", "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "timestamp_ntz": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP",
    "bytea": "BINARY", "json": "VARIANT", "jsonb": "VARIANT",
}


def spark_type(kind: str) -> str:
    """Spark's name of a type; unknown names pass through."""
    array = kind.endswith("[]")
    name, _, size = kind.removesuffix("[]").partition("(")
    found = TYPES.get(name, name.upper())
    if found == "DECIMAL" and size:
        found += f"({size}"
    return f"ARRAY<{found}>" if array else found


#: Calls that are written otherwise in Spark: by number of arguments ('' for any), a template of {0}, {1} ... or {all}.
CALLS = {
    ("version", 0): "'PostgreSQL 9.6.0'",
    ("current_schema", 0): "'public'",
    ("log", 1): "log10({0})",
    ("trunc", 1): "({0} - {0} % 1)",
    ("trunc", 2): "(({0} * power(10, {1}) - ({0} * power(10, {1})) % 1) / power(10, {1}))",
    ("strpos", 2): "instr({0}, {1})",
    ("to_hex", 1): "lower(hex({0}))",
    ("fusion", 1): "flatten(collect_list({0}))",
    ("collect", 1): "collect_list({0})",
    ("array_agg", 1): "collect_list({0})",
    ("intersection", 1): "aggregate(collect_list({0}), element_at(collect_list({0}), 1), (x, y) -> array_intersect(x, y))",
    ("sind", 1): "sin(radians({0}))",
    ("cosd", 1): "cos(radians({0}))",
    ("tand", 1): "tan(radians({0}))",
    ("asind", 1): "degrees(asin({0}))",
    ("acosd", 1): "degrees(acos({0}))",
    ("atand", 1): "degrees(atan({0}))",
    ("random", 0): "rand()",
    ("string_agg", 2): "array_join(collect_list({0}), {1})",
}


def rendered(name: str, args: list[str]) -> str | None:
    """Spark SQL of a call that differs, or None."""
    if name == "concat":
        return f"concat_ws('', {', '.join(f'CAST({a} AS STRING)' for a in args)})"
    template = CALLS.get((name, len(args)))
    return template.format(*args) if template else None
