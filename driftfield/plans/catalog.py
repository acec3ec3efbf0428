"""Imports every module that registers queries."""

import importlib

MODULES = ("q_points", "q_rules", "q_sample", "q_paths", "q_density", "q_sources", "q_arrays")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"driftfield.plans.{name}")
