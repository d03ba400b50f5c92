"""Connected components, as the library has them."""

from siltstone.operators.components import components

__all__ = ["components"]
