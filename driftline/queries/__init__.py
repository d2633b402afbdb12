"""Registered queries: every operator on the given tables, with its SQL equivalent."""

from driftline.queries import aggregates, growth, joins, mixed_models, models, rows, sources, study, windows  # noqa: F401
from driftline.queries.registry import ORACLE, QUERIES  # noqa: F401
