"""Where arguments come from: DataFrames by way of Table, Arrow and numpy arrays, Python values.

Files, clocks and networks stay closed to the notation itself; data enters only by binding.
"""

from ..plans.values import Table
from ..values import from_arrow, from_python, to_python

__all__ = ["Table", "from_arrow", "from_python", "to_python"]
