"""Importing the package registers all of its queries."""

from . import alignment, catalogue, evaluation, production, streams  # noqa: F401
