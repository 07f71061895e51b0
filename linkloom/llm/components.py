"""Groups of records that are linked directly or indirectly; the contraction itself is shared with the contact operators."""

from ..operators.components import connected_components

__all__ = ["connected_components"]
