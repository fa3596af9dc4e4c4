"""Evolving-graph analytics expressed as Spark DataFrame plans."""

from tidegraph.config import EvolveConfig
from tidegraph.functions.semiring import SEMIRINGS, Semiring

__all__ = ["EvolveConfig", "SEMIRINGS", "Semiring"]
