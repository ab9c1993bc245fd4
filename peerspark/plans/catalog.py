"""Imports every plan module so that the registry is complete."""

from . import causal, cleaning, ranking, retention, state, streams, study, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
