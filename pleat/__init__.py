"""Array notation over Spark DataFrames."""

from .api import Kernel, Result, apl, apl_modern, apl_with, j
from .plans.values import Table

__all__ = ["Kernel", "Result", "Table", "apl", "apl_modern", "apl_with", "j"]
