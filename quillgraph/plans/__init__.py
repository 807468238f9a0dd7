"""Registered queries: importing the package registers all of them."""

from quillgraph.plans import analysis, catalog, checks, evaluation, features, fields, learning, release, rows  # noqa: F401
from quillgraph.plans.registry import ORACLES, QUERIES  # noqa: F401
