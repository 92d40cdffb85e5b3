"""Volume operators. Importing this package registers all of them."""

from . import columns, kernels, kspace  # noqa: F401  (registration)
from .registry import OPERATORS, apply_operator, catalogue, chain, get, operator

__all__ = ["OPERATORS", "apply_operator", "catalogue", "chain", "get", "operator"]
