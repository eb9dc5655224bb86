"""Spark engine for logged control episodes: prompts, rewards, advantages, reports."""

__version__ = "0.1.0"
