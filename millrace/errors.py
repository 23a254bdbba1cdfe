"""Errors of flows."""

from __future__ import annotations

from typing import Any


class ProcessorError(Exception):
    """A step failed; carries the cause, the step's name and its position in the flow."""

    def __init__(self, cause: Exception, step: str, position: int):
        self.cause, self.processor_name, self.processor_position = cause, step, position
        super().__init__(f"Errored in processor {step} in position #{position}: {cause}")


class ValidationError(Exception):
    """A row doesn't fit its schema."""

    def __init__(self, resource: str, row: Any, index: int | None, errors: Any):
        self.resource_name, self.row, self.index, self.cast_error = resource, row, index, errors
        super().__init__(f"ROW {'' if index is None else index}: {errors} in resource {resource}: {row}")


class SourceLoadError(Exception):
    """A source can't be read."""
