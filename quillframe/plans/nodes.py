"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    kind: str  # string, int, number, bool or null
    text: str


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "any"


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Unary:
    op: str  # not or neg
    operand: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


Expr = Literal | Field | ListOf | Unary | Binary | Call


@dataclass(frozen=True)
class SortTerm:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Assign:
    target: Field
    op: str = "="  # =, += or -=
    value: Expr | None = None  # None: cast the field where it is


@dataclass(frozen=True)
class Select:
    sources: tuple[str, ...]
    columns: tuple = ()
    star: bool = False
    where: Expr | None = None
    sort: tuple[SortTerm, ...] = ()
    limit: int = 0  # 0: all

    mutates = False


@dataclass(frozen=True)
class Update:
    sources: tuple[str, ...]
    assigns: tuple[Assign, ...]
    where: Expr | None = None

    mutates = True

    @property
    def columns(self) -> tuple:
        return tuple(a.target for a in self.assigns)


@dataclass(frozen=True)
class Drop:
    sources: tuple[str, ...]
    fields: tuple[Field, ...]
    where: Expr | None = None

    mutates = True
    columns = ()


@dataclass(frozen=True)
class Rename:
    sources: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    where: Expr | None = None

    mutates = True

    @property
    def columns(self) -> tuple:
        return tuple(Field(new) for _, new in self.pairs)


Statement = Select | Update | Drop | Rename


@dataclass(frozen=True)
class Program:
    statements: tuple[Statement, ...] = field(default=())


def column_name(expr: Expr, position: int) -> str:
    """Header of a projected expression; position counts from 0."""
    return expr.name if isinstance(expr, Field) else f"expr{position + 1}"
