"""The metric query language: syntax, planning and compilation to DataFrames."""

from lumenspar.metricql.evaluate import Engine, Result
from lumenspar.metricql.syntax import QueryError, parse

__all__ = ["Engine", "QueryError", "Result", "parse"]
