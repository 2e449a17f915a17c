"""Row arithmetic from expression trees: ``{"col": name}``, ``{"lit": number}``, ``{"op": name, "args": [..]}``."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.core.checks import col, ratio

OPERATIONS = {
    "sum": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": ratio,
}


def operands(tree: dict) -> set[str]:
    """The columns that a tree reads; raises ValueError where it is malformed."""
    if not isinstance(tree, dict):
        raise ValueError("an expression must be a dictionary")
    if set(tree) == {"col"} and isinstance(tree["col"], str) and tree["col"]:
        return {tree["col"]}
    if set(tree) == {"lit"} and isinstance(tree["lit"], (int, float)) and not isinstance(tree["lit"], bool) and math.isfinite(tree["lit"]):
        return set()
    if set(tree) == {"op", "args"} and tree["op"] in OPERATIONS and isinstance(tree["args"], (list, tuple)):
        count = len(tree["args"])
        if count < 2 or tree["op"] in ("subtract", "divide") and count != 2:
            raise ValueError(f"{tree['op']} has {count} arguments")
        return set().union(*map(operands, tree["args"]))
    raise ValueError(f"malformed expression: {tree!r}")


def compiled(tree: dict) -> Column:
    """The tree as a column; NaN counts as null, division by zero gives null."""
    if "col" in tree:
        value = col(tree["col"]).cast("double")
        return F.when(~F.isnan(value), value)
    if "lit" in tree:
        return F.lit(float(tree["lit"]))
    return functools.reduce(OPERATIONS[tree["op"]], map(compiled, tree["args"]))
