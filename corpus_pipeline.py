"""Corpus pipeline: stages over `documents`, each written and read again before the next."""

from __future__ import annotations

from seqloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
