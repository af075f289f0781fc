"""Asset ingestion and verification as Spark DataFrame operators."""

from cargohold.config import JobConfig

__all__ = ["JobConfig"]
