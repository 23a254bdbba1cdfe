"""millrace: flows of composable steps over packages of named, schema-carrying Spark tables."""

from .errors import ProcessorError, SourceLoadError, ValidationError
from .flow import Flow, PackageWrapper, Processor, Step, row_function, rows_function
from .functions.cast import clear, drop, ignore, raise_exception
from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .package import Package, Resource
from .schema import TableSchema
from .sources import *  # noqa: F403
from .sources import __all__ as _sources
from .operators.metadata import sources  # noqa: I001  the step, not the folder of the same name

__version__ = "0.1.0"
__all__ = [
    "Flow", "Package", "PackageWrapper", "Processor", "ProcessorError", "Resource", "SourceLoadError", "Step", "TableSchema", "ValidationError",
    "clear", "drop", "ignore", "raise_exception", "row_function", "rows_function", "sources", *_operators, *_sources,
]
