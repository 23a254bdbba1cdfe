"""Steps that transform packages."""

from .columns import add_computed_field, add_field, delete_fields, find_replace, rename_fields, select_fields, set_type, unpivot
from .control import checkpoint, conditional, finalizer, parallelize, printer
from .join import join, join_self, join_with_self
from .metadata import add_metadata, delete_resource, set_primary_key, sources, update_package, update_resource, update_schema, update_stats
from .rows import concatenate, deduplicate, duplicate, filter_rows, limit_rows, sort_rows, validate

__all__ = [
    "add_computed_field", "add_field", "add_metadata", "checkpoint", "concatenate", "conditional", "deduplicate", "delete_fields", "delete_resource", "duplicate", "filter_rows",
    "finalizer", "find_replace", "join", "join_self", "join_with_self", "limit_rows", "parallelize", "printer", "rename_fields", "select_fields", "set_primary_key", "set_type",
    "sort_rows", "sources", "unpivot", "update_package", "update_resource", "update_schema", "update_stats", "validate",
]
