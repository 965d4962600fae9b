"""The corpus pipeline: each stage works on all that the one before has kept, and its result is written and read again."""

from scriptorium.llm.pipeline import STAGES, run

#: Language ID, near-duplicates and sentence pieces have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
