"""Built-in factor families: each a dictionary of formulas by output name."""

from __future__ import annotations

from ..expr import Node
from . import alpha158, provider, purified, temporal
from .registry import DUPLICATES, canonical, registry

__all__ = ["DUPLICATES", "Node", "alpha158", "canonical", "provider", "purified", "registry", "temporal"]
