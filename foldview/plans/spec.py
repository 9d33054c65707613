"""View descriptions: sources, projections, mappers, reducer, formatter; and the graph they form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from ..functions.mappers import Expr, Mapper
from ..functions.reducers import Reducer
from .schema import Schema


@dataclass(frozen=True)
class MapSpec:
    """One map of a source: the declared value fields, the source's name and ids, and the mapper."""

    values: tuple[str, ...]
    source: Schema
    mapper: Mapper
    name: str | None = None


@dataclass(frozen=True)
class ViewSpec:
    name: str
    keys: tuple[str, ...]
    values: tuple[str, ...]
    maps: tuple[MapSpec, ...]
    reducer: Reducer
    formats: tuple[Expr, ...] = ()
    format_values: tuple[str, ...] = ()
    salts: int = 1
    partitions: int | None = field(default=None, compare=False)

    @property
    def out(self) -> tuple[str, ...]:
        return self.format_values or self.values


def ordered(views: dict[str, ViewSpec], wanted: Sequence[str]) -> list[ViewSpec]:
    """The wanted views and what they are made of, sources first; a cycle is an error."""
    out: list[ViewSpec] = []
    state: dict[str, int] = {}

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name not in views or state.get(name) == 2:
            return
        if state.get(name) == 1:
            raise ValueError(f"views form a cycle: {' -> '.join((*path, name))}")
        state[name] = 1
        for m in views[name].maps:
            visit(m.source.name or "", (*path, name))
        state[name] = 2
        out.append(views[name])

    for name in wanted:
        visit(name, ())
    return out
