"""Declarative optimisation models compiled to Spark DataFrames."""

from .document import MathSchema, ValidationError
from .functions.registry import register
from .model import Model

__all__ = ["MathSchema", "Model", "ValidationError", "register"]
