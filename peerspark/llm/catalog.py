"""All queries of this subpackage."""

from . import queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
