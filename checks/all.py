"""Imports every module that registers queries."""

from checks import extraction, graphs, scoring, texts_paths, upkeep  # noqa: F401
