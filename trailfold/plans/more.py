"""Further registered queries (split from ``catalog`` by operator family)."""

from __future__ import annotations

from trailfold.plans import trace_queries  # noqa: F401
from trailfold.plans import feature_queries  # noqa: F401
from trailfold.plans import eval_queries  # noqa: F401
from trailfold.plans import retrieval_queries  # noqa: F401
from trailfold.plans import model_queries  # noqa: F401
from trailfold.plans import io_queries  # noqa: F401
