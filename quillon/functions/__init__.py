"""Scalar functions as Column expressions; FUNCTIONS maps each SQL name to its builder."""

from quillon.functions.datetime import FUNCTIONS as _DATETIME
from quillon.functions.numeric import FUNCTIONS as _NUMERIC
from quillon.functions.strings import FUNCTIONS as _STRINGS
from quillon.functions.system import FUNCTIONS as _SYSTEM

FUNCTIONS = _STRINGS | _NUMERIC | _DATETIME | _SYSTEM


def call(name: str, *args):
    """The function of a SQL name, in any case, applied to columns and constants."""
    return FUNCTIONS[name.upper()](*args)
