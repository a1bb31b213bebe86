"""Queries of this subpackage."""

from __future__ import annotations

import importlib


def modules() -> list:
    return [importlib.import_module(f"pedlake.llm.plans_{m}") for m in ("splits", "text", "spam")]
