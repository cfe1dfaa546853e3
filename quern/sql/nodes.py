"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    """Any part of a statement."""


@dataclass(frozen=True)
class Literal(Node):
    kind: str  # integer, float, string, bool, null
    value: object


@dataclass(frozen=True)
class Name(Node):
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Star(Node):
    table: tuple[str, ...] = ()


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Window(Node):
    partition: tuple[Node, ...] = ()
    order: tuple = ()
    frame: str = ""
    base: str | None = None  # a window of the WINDOW clause


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False
    where: Node | None = None
    over: Window | None = None
    order: tuple = ()
    within: tuple = ()  # WITHIN GROUP (ORDER BY ...)


@dataclass(frozen=True)
class Trim(Node):
    side: str
    chars: Node | None
    arg: Node


@dataclass(frozen=True)
class Cast(Node):
    arg: Node
    kind: str


@dataclass(frozen=True)
class Case(Node):
    base: Node | None
    branches: tuple[tuple[Node, Node], ...]
    other: Node | None


@dataclass(frozen=True)
class Like(Node):
    op: str
    arg: Node
    pattern: Node
    escape: Node | None = None
    negated: bool = False


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class Is(Node):
    arg: Node
    what: str
    other: Node | None = None


@dataclass(frozen=True)
class In(Node):
    arg: Node
    options: tuple[Node, ...]
    negated: bool = False


@dataclass(frozen=True)
class SubQuery(Node):
    query: Node
    kind: str = "scalar"  # scalar or exists


@dataclass(frozen=True)
class Quantified(Node):
    op: str
    kind: str  # any or all
    left: Node
    query: Node


@dataclass(frozen=True)
class Tuple(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Interval(Node):
    text: str


@dataclass(frozen=True)
class Column(Node):
    value: Node
    alias: str | None = None


@dataclass(frozen=True)
class Order(Node):
    value: Node
    direction: str | None = None
    nulls: str | None = None


@dataclass(frozen=True)
class Table(Node):
    parts: tuple[str, ...]
    alias: str | None = None
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Derived(Node):
    query: Node
    alias: str | None = None
    columns: tuple[str, ...] = ()
    lateral: bool = False


@dataclass(frozen=True)
class Function(Node):
    call: Call
    alias: str | None = None
    columns: tuple[str, ...] = ()
    lateral: bool = False


@dataclass(frozen=True)
class Join(Node):
    how: str  # inner, left, right, full, cross, semi, anti
    left: Node
    right: Node
    on: Node | None = None
    using: tuple[str, ...] = ()
    natural: bool = False


@dataclass(frozen=True)
class Select(Node):
    columns: tuple[Column, ...]
    sources: tuple[Node, ...] = ()
    where: Node | None = None
    groups: tuple = ()  # nodes, or (kind, list of tuples of nodes) for rollup, cube and grouping sets
    having: Node | None = None
    distinct: bool = False
    distinct_on: tuple[Node, ...] = ()
    windows: tuple[tuple[str, Window], ...] = ()
    hint: str = ""


@dataclass(frozen=True)
class Values(Node):
    rows: tuple[tuple[Node, ...], ...]


@dataclass(frozen=True)
class SetOp(Node):
    op: str
    every: bool
    left: Node
    right: Node


@dataclass(frozen=True)
class Query(Node):
    body: Node
    ctes: tuple[tuple[str, tuple[str, ...], Node], ...] = ()
    order: tuple[Order, ...] = ()
    limit: Node | None = None
    offset: Node | None = None
    recursive: bool = False


@dataclass(frozen=True)
class CopyFrom(Node):
    table: tuple[str, ...]
    path: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class CopyTo(Node):
    table: tuple[str, ...]
    path: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Drop(Node):
    tables: tuple[tuple[str, ...], ...]
    missing_ok: bool = False


@dataclass(frozen=True)
class CreateAs(Node):
    table: tuple[str, ...]
    query: Node


@dataclass(frozen=True)
class Show(Node):
    option: str
