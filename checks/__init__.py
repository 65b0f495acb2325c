"""Registered queries, each next to the SQL that gives the same answer."""

from __future__ import annotations

import importlib

MODULES = ("sources", "sinks", "running", "steps", "plans", "text", "streams", "workloads")


def collect(name: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        merged |= getattr(importlib.import_module(f"checks.{module}"), name)
    return merged
