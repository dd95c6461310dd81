"""A small predicate language over nested and repeated fields, compiled to Spark columns."""

from .compiler import compile_predicate
from .parser import parse

__all__ = ["compile_predicate", "parse"]
