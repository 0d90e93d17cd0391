"""Settings of the second notation, fixed when a program is compiled."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    """``origin`` is the first index; ``up_mixes`` gives the arrows their meaning of the other school: ↑ mixes and ⊃ takes the first."""

    origin: int = 1
    up_mixes: bool = False
    depth_signed: bool = False
    partition_counts: bool = False


STANDARD = Dialect()
MODERN = Dialect(up_mixes=True, depth_signed=True, partition_counts=True)
