"""Registered queries and their oracle SQL, one per operator."""

from . import data, evaluation, groups, learning, policies, rewards, streams, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
