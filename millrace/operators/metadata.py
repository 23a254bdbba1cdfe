"""Steps that change descriptors only."""

from __future__ import annotations

from typing import Any

from ..flow import Step
from ..package import Package, Resource


def update_package(**metadata: Any) -> Step:
    """Package metadata, merged; ``resources`` can't be set this way."""
    given = {k: v for k, v in metadata.items() if k != "resources"}
    return Step("update_package", lambda p, c: p.with_(metadata={**p.metadata, **given}))


add_metadata = update_package


def update_resource(resources: Any, **properties: Any) -> Step:
    """Resource properties, merged; ``name`` renames it."""

    def change(r: Resource) -> Resource:
        rest = {k: v for k, v in properties.items() if k not in ("name", "schema")}
        return r.with_(name=properties.get("name", r.name), properties={**r.properties, **rest})

    return Step("update_resource", lambda p, c: p.change(resources, change))


def update_schema(resources: Any, **properties: Any) -> Step:
    """Schema properties, merged, such as missingValues."""

    def change(r: Resource) -> Resource:
        schema = r.schema.copy()
        for k, v in properties.items():
            if k == "missingValues":
                schema.missing_values = list(v)
            elif k == "primaryKey":
                schema.primary_key = [v] if isinstance(v, str) else list(v)
            elif k == "fields":
                schema.fields = [{**f, **next((x for x in v if x["name"] == f["name"]), {})} for f in schema.fields]
            else:
                schema.properties[k] = v
        return r.with_(schema=schema)

    return Step("update_schema", lambda p, c: p.change(resources, change))


def set_primary_key(primary_key: list[str], resources: Any = None) -> Step:
    """The primary key; an empty one removes it."""

    def change(r: Resource) -> Resource:
        schema = r.schema.copy()
        schema.primary_key = list(primary_key or [])
        return r.with_(schema=schema)

    return Step("set_primary_key", lambda p, c: p.change(resources, change))


def update_stats(stats: dict) -> Step:
    """Entries for the flow's stats."""
    return Step("update_stats", lambda p, c: p.with_(stats=(*p.stats, dict(stats))))


def delete_resource(resources: Any) -> Step:
    """Without the chosen resources."""
    return Step("delete_resource", lambda p, c: p.change(resources, lambda r: None))


def sources(*flows: Any) -> Step:
    """The resources of several independent flows, iterables or DataFrames; later metadata wins."""
    from ..flow import Context, Flow

    def plan(package: Package, c: Context) -> Package:
        for f in flows:
            made = (f if isinstance(f, Flow) else Flow(f)).plan(Package(), c.ordered, c.spark)
            package = package.add(*made.resources).with_(metadata={**package.metadata, **made.metadata}, stats=(*package.stats, *made.stats), finalizers=(*package.finalizers, *made.finalizers))
        return package

    return Step("sources", plan)
