"""The query registry: ``name -> (spark_builder, oracle_sql or None)``.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole driver tables (through the lenses).  The oracle SQL is the same
query stated for DuckDB; ``None`` marks rows-only queries (iterative or
model-fitting operators with no SQL form).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailfold.plans import oracle as O
from trailfold.plans.inputs import Inputs
from trailfold.schemas import FEATURES
from trailfold.operators import counts

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Callable[[Inputs], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        REGISTRY[name] = (build, sql)
        return fn
    return deco


_FEATS = ", ".join(FEATURES)


# ---------------------------------------------------------------- counts
@register("rule_counts", O.q(
    "SELECT experiment, RuleName AS rule, count(*) AS n FROM trace GROUP BY experiment, RuleName"))
def _rule_counts(i: Inputs) -> DataFrame:
    return counts.rule_counts(i.trace)


@register("feature_matrix", O.q(
    f"SELECT fc.experiment, {', '.join('fc.' + f for f in FEATURES)}, l.year, l.label, l.test "
    "FROM fc JOIN labels_l l ON fc.experiment = l.experiment", O.FEATURE_COUNTS))
def _feature_matrix(i: Inputs) -> DataFrame:
    return counts.feature_matrix(i.trace, i.labels)


def queries() -> dict[str, Builder]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def _load_all() -> None:
    # Registration side effects of the other plan modules.
    from trailfold.plans import more  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline query: the bounded per-experiment trace summary."""
    _load_all()
    name = "trace_summary" if "trace_summary" in REGISTRY else "feature_matrix"
    return REGISTRY[name][0](spark, sf_dir)
