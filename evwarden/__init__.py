"""Checking invariants over event tables and event streams with Spark."""

import sys

from pyspark import cloudpickle

from evwarden.model import DEFAULT, Alias, Invariant, InvariantError, Not, Or, Plus, Star, Step
from evwarden.operators import CellOptions, check, check_all, find_matches
from evwarden.predicates import attr

__all__ = [
    "DEFAULT", "Alias", "CellOptions", "Invariant", "InvariantError", "Not", "Or", "Plus", "Star", "Step",
    "attr", "check", "check_all", "find_matches",
]

# Functions and classes that run inside tasks travel by value, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
