"""Packages: ordered, named tables as lazy DataFrames with their schemas and metadata."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from .schema import TableSchema

#: Arrival order of rows, where a later step needs it; never seen by users.
ORDER = "__order"


@dataclass(frozen=True)
class Resource:
    """A table: lazy rows, schema and properties. ``ordered``: the rows carry ORDER."""

    name: str
    df: DataFrame
    schema: TableSchema
    properties: dict = field(default_factory=dict)
    ordered: bool = False

    def with_(self, **changes: Any) -> Resource:
        return replace(self, **changes)

    @property
    def rows(self) -> DataFrame:
        """The user's columns."""
        return self.df.select(*[quoted(n) for n in self.schema.names])

    @property
    def descriptor(self) -> dict:
        return {"name": self.name, **copy.deepcopy(self.properties), "schema": self.schema.descriptor}


@dataclass(frozen=True)
class Package:
    resources: tuple[Resource, ...] = ()
    metadata: dict = field(default_factory=dict)
    stats: tuple[dict, ...] = ()
    finalizers: tuple[Callable, ...] = ()

    def with_(self, **changes: Any) -> Package:
        return replace(self, **changes)

    @property
    def descriptor(self) -> dict:
        return {**copy.deepcopy(self.metadata), "resources": [r.descriptor for r in self.resources]}

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.resources]

    def __getitem__(self, name: str) -> Resource:
        for r in self.resources:
            if r.name == name:
                return r
        raise KeyError(f"no resource {name!r}; there are {self.names}")

    def add(self, *new: Resource) -> Package:
        """With more resources; names that are taken get a number."""
        out, taken = list(self.resources), set(self.names)
        for r in new:
            name, k = r.name, 1
            while name in taken:
                k += 1
                name = f"{r.name}_{k}"
            taken.add(name)
            out.append(r.with_(name=name))
        return self.with_(resources=tuple(out))

    def change(self, selector: Any, how: Callable[[Resource], Resource | None]) -> Package:
        """With ``how`` applied to the chosen resources; None removes one."""
        chosen = select(self, selector)
        done = [how(r) if r.name in chosen else r for r in self.resources]
        return self.with_(resources=tuple(r for r in done if r is not None))


def select(package: Package, selector: Any) -> set[str]:
    """Names of chosen resources: None for all, an anchored pattern, an index, a list of names, or a boolean for all or none."""
    names = package.names
    if selector is None or selector is True:
        return set(names)
    if selector is False:
        return set()
    if isinstance(selector, str):
        pattern = re.compile(f"^(?:{selector})$")
        return {n for n in names if pattern.match(n)}
    if isinstance(selector, int):
        return {names[selector]} if -len(names) <= selector < len(names) else set()
    return {n for n in names if n in set(selector)}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
