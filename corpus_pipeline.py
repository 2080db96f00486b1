"""Corpus pipeline of the training-data operators; see ``tagloom.llm.pipeline``."""

from tagloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
