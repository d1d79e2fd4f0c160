"""The registered queries, grouped by subject."""

from __future__ import annotations

import importlib

from tablewright.suite.registry import Suite

SUBJECTS = ("querying", "profiles", "linking", "files", "training", "models")


def all_queries() -> Suite:
    whole = Suite()
    for subject in SUBJECTS:
        whole.include(importlib.import_module(f"tablewright.suite.{subject}").suite)
    return whole
