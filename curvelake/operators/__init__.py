"""Operators on fields.  Importing this package registers them all."""

from curvelake.operators import curves, grids, plugins, relational

__all__ = ["curves", "grids", "plugins", "relational"]
