"""The registry of functions: a name, its aliases, how many arguments it takes, its kind, and a builder of Columns.

Kinds: scalar (Columns to a Column), aggregate (Columns to an aggregate Column), table (operators on DataFrames).
A builder gives NULL where a spreadsheet gives an error value; NULL stands for a blank cell too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Function:
    name: str
    kind: str
    least: int
    most: int
    build: Callable
    aliases: tuple[str, ...] = ()

    def __call__(self, *args):
        if not self.least <= len(args) <= self.most:
            raise TypeError(f"{self.name} takes {self.least} to {self.most} arguments, not {len(args)}")
        return self.build(*(a if isinstance(a, (Column, list)) or callable(a) else F.lit(a) for a in args))


FUNCTIONS: dict[str, Function] = {}


def add(names: str, least: int, most: int, build: Callable, kind: str = "scalar") -> None:
    name, *aliases = names.split()
    f = Function(name, kind, least, most, build, tuple(aliases))
    for n in (name, *aliases):
        if n in FUNCTIONS:
            raise ValueError(f"{n} is registered twice")
        FUNCTIONS[n] = f


def function(name: str) -> Function:
    """The function of a name or alias, in any case; a KeyError names what is unknown."""
    from tabulon.functions import aggregates, bonds, kernels, scalar, tables  # noqa: F401  they register

    return FUNCTIONS[name.upper().removeprefix("_XLFN.").removeprefix("_XLWS.")]


def catalog(spark):
    """name, kind, least, most, canonical of every accepted name."""
    function("ABS")
    return spark.createDataFrame([(n, f.kind, f.least, f.most, f.name) for n, f in sorted(FUNCTIONS.items())], "name string, kind string, least int, most int, canonical string")
