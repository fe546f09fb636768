"""Imports every query module, so that the registry is complete."""

from rosterlens.plans import q_cells, q_grading, q_labels, q_runs, q_scores, q_sources, q_splits, q_stream, q_tasks, q_text, q_vectors  # noqa: F401
from rosterlens.plans.registry import QUERIES, SQL  # noqa: F401
