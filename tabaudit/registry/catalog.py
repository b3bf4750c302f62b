"""All registered queries; importing the modules fills the registry."""

from tabaudit.registry import lending_queries, marketplace_queries, operator_queries  # noqa: F401
from tabaudit.registry.core import REGISTRY

__all__ = ["REGISTRY"]
