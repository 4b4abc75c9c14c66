"""Reading and writing tables."""

from .tables import load, save, save_bucketed

__all__ = ["load", "save", "save_bucketed"]
