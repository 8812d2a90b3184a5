"""The corpus pipeline, which lives in logweave.llm."""

from logweave.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run  # noqa: F401
