"""The log search language: syntax and compilation to a filter column."""

from lumenspar.logql.compile import compile_filter, with_attributes
from lumenspar.logql.syntax import LogQueryError, parse

__all__ = ["LogQueryError", "compile_filter", "parse", "with_attributes"]
