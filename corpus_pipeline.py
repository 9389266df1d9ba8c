"""The corpus pipeline: STAGES in order, run() over a folder's tables, and ORACLE_SQL for its rows."""

from waymark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
