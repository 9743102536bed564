"""The query language: text to statement objects."""

from .parser import parse

__all__ = ["parse"]
