"""Spark analytics for gridded climate fields and their request catalogue."""

from isohypsa.params import GridSpec

__all__ = ["GridSpec"]
