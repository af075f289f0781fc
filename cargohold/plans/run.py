"""Both jobs, each optional."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cargohold.config import JobConfig
from cargohold.plans.assets import ingest_images, report
from cargohold.plans.metadata import image_list_from_archive, ingest_metadata
from cargohold.sources.fetch import Fetcher, HttpFetcher
from cargohold.sources.manifest import top_dir


def run(
    spark: SparkSession,
    cfg: JobConfig,
    fetcher: Fetcher | None = None,
    manifest_rows: DataFrame | None = None,
    resizer: Callable[[bytes], bytes] | None = None,
) -> dict[str, DataFrame]:
    """`metadata`: extracted entries; `images`: result rows; `report`: counts. Raises when a job fails."""
    source = fetcher or HttpFetcher()
    out: dict[str, DataFrame] = {}
    if cfg.download_metadata:
        out["metadata"] = ingest_metadata(spark, cfg, source, manifest_rows)
    if cfg.download_images:
        rows = image_list_from_archive(spark, cfg, source, manifest_rows)
        out["images"] = ingest_images(rows, cfg, top_dir(cfg.dataset_version), source, resizer)
        out["report"] = report(out["images"])
    return out
