"""Intermediate tables of the training-data operators: those of the library."""

from __future__ import annotations

from memspark.operators.stored import drop_stored, shared_dir, stored

__all__ = ["drop_stored", "shared_dir", "stored"]
