"""Imports every query module so that the registry is complete."""

from . import q_aria, q_blocks, q_cells, q_compare, q_entries, q_grids, q_markdown, q_nodes, q_payloads, q_profiles, q_repair, q_rules, q_sources, q_stream, q_tables  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
