"""From raw documents to packed training sequences; the stages are in reelmark.llm.pipeline."""

from reelmark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
