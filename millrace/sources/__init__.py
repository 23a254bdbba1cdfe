"""Sources and sinks."""

from .dump import dump_to_path, dump_to_sql, dump_to_zip
from .load import CAST_DO_NOTHING, CAST_TO_STRINGS, CAST_WITH_SCHEMA, INFER_FULL, INFER_PYTHON_TYPES, INFER_STRINGS, load
from .stream import stream, unstream

__all__ = ["CAST_DO_NOTHING", "CAST_TO_STRINGS", "CAST_WITH_SCHEMA", "INFER_FULL", "INFER_PYTHON_TYPES", "INFER_STRINGS", "dump_to_path", "dump_to_sql", "dump_to_zip", "load", "stream", "unstream"]
