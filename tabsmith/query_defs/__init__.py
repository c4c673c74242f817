"""Query definitions, grouped by operator family."""

from tabsmith.query_defs import cleaning, dashboard, drift, evaluation, governance, importance, modelops, profiling, quality, rules, serving, training  # noqa: F401
