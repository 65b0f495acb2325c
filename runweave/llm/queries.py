"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import importlib

MODULES = ("urls", "substring", "multiset", "huffman", "counts", "wordtable", "jaccard", "quality", "mixing", "topk",
           "resample", "whitening", "secrets")


def collect(name: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        merged |= getattr(importlib.import_module(f"runweave.llm.{module}"), name)
    return merged
