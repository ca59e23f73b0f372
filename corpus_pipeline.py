"""The corpus pipeline: STAGES applied in turn to `documents`, as askloom.llm.pipeline has them."""

from __future__ import annotations

from askloom.llm.pipeline import STAGES, run

#: The packing stage counts tokens of a library, which SQL can't; tests/llm checks the stages against brute force.
ORACLE_SQL = None
__all__ = ["ORACLE_SQL", "STAGES", "run"]
