"""The parsed schema: what one search document is made of."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any


class SchemaError(ValueError):
    """A schema that cannot be used; ``path`` says where."""

    def __init__(self, path: str, message: str) -> None:
        super().__init__(f"{path}: {message}" if path else message)
        self.path = path


@dataclass(frozen=True)
class Filter:
    op: str
    column: str | None = None
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Order:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class Through:
    table: str
    left_key: str
    right_key: str


@dataclass(frozen=True)
class SoftDelete:
    column: str | None = None
    field: str | None = None
    when: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Field:
    """One field.  ``kind`` is scalar, geo, map, object, join, aggregate or constant; ``type`` its type, verb or operation."""

    kind: str
    type: str
    name: str
    column: str | None = None
    required: bool = False
    options: dict[str, Any] = field(default_factory=dict)
    transforms: tuple[str, ...] = ()
    default: Any = None
    variants: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()
    index_type: str | None = None
    lat: str | None = None
    lon: str | None = None
    value: Any = None
    fields: tuple[Field, ...] = ()
    table: str | None = None
    primary_key: str | None = None
    foreign_key: str | None = None
    through: Through | None = None
    filters: tuple[Filter, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    value_type: str | None = None

    @property
    def to_many(self) -> bool:
        return self.type in ("has_many", "many_to_many")


@dataclass(frozen=True)
class Schema:
    index: str
    table: str
    primary_key: tuple[str, ...]
    fields: tuple[Field, ...]
    soft_delete: SoftDelete | None = None
    filters: tuple[Filter, ...] = ()
    db_schema: str | None = None

    def walk(self) -> Iterator[tuple[tuple[Field, ...], Field]]:
        """Every field with its enclosing fields, outermost first."""

        def each(fields: tuple[Field, ...], above: tuple[Field, ...]) -> Iterator[tuple[tuple[Field, ...], Field]]:
            for f in fields:
                yield above, f
                yield from each(f.fields, (*above, f))

        return each(self.fields, ())

    def find(self, path: str) -> Field | None:
        return next((f for above, f in self.walk() if ".".join(x.name for x in (*above, f)) == path), None)

    def tables(self) -> dict[str, set[str]]:
        """Every table read, with the columns that are needed of it (raw filters aside)."""
        out: dict[str, set[str]] = {self.table: set(self.primary_key)}

        def need(table: str, *columns: str | None) -> None:
            out.setdefault(table, set()).update(c for c in columns if c)

        def visit(fields: tuple[Field, ...], table: str, key: str | None) -> None:
            for f in fields:
                if f.kind in ("scalar", "map", "geo"):
                    need(table, f.column, f.lat, f.lon)
                elif f.kind == "object":
                    visit(f.fields, table, key)
                elif f.kind in ("join", "aggregate"):
                    need(f.table, f.primary_key, *(x.column for x in f.filters), *(o.column for o in f.order_by))
                    if f.through:
                        need(f.through.table, f.through.left_key, f.through.right_key)
                    elif f.type == "belongs_to":
                        need(table, f.column)
                    else:
                        need(f.table, f.foreign_key)
                    if f.kind == "aggregate":
                        need(f.table, f.column)
                    visit(f.fields, f.table, f.primary_key)

        visit(self.fields, self.table, self.primary_key[0])
        need(self.table, *(x.column for x in self.filters))
        if self.soft_delete:
            need(self.table, self.soft_delete_column, *(x.column for x in self.soft_delete.when))
        return out

    @property
    def soft_delete_column(self) -> str | None:
        sd = self.soft_delete
        if sd is None:
            return None
        if sd.column:
            return sd.column
        found = next((f for above, f in self.walk() if f.name == sd.field and f.kind in ("scalar", "map") and all(x.kind == "object" for x in above)), None)
        return found.column if found else None
