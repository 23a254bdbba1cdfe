"""Ready-made queries, one for each operator, with their SQL."""

from . import queries, roundtrips  # noqa: F401  both register what they define
