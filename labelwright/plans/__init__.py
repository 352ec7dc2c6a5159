"""Registered queries; importing the package fills the catalog."""

import importlib

from labelwright.plans.catalog import ORACLES, QUERIES

for _module in ("dashboards", "compliance", "labels", "fields", "nutrition", "complaints", "training", "telemetry", "files"):
    importlib.import_module(f"labelwright.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
