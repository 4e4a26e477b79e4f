"""All registered queries. Importing a module registers its queries."""

from __future__ import annotations

from . import features, patterns, signals, learning, preparation, evaluation, portfolio  # noqa: F401
from .base import REGISTERED

QUERIES = REGISTERED
