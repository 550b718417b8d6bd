"""Registered queries: each applies an operator to fixtures of the driver's tables, with SQL for the same rows."""

from . import q_features, q_focal, q_grids, q_models, q_pixels, q_profiles, q_stats  # noqa: F401
