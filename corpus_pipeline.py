"""The corpus pipeline: STAGES lists its stages, run(spark, sf_dir) applies them to documents."""

from __future__ import annotations

from rankweave.llm.stages import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
