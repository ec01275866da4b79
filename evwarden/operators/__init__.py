from evwarden.operators.cells import CellOptions
from evwarden.operators.check import check, check_all, find_matches

__all__ = ["CellOptions", "check", "check_all", "find_matches"]
