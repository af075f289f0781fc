"""Job options, their defaults and their checks."""

from __future__ import annotations

from dataclasses import dataclass

DATASET_VERSIONS = (1, 2, 3)
RESIZE_MODES = ("ShrinkToFit", "FillCrop", "FillDistort")


@dataclass(frozen=True)
class JobConfig:
    root: str = "."
    original_images_subdirectory: str = "images-original"
    check_md5_if_exists: bool = True
    always_download: bool = False
    save_tarballs: bool = False
    download_metadata: bool = True
    download_images: bool = True
    download_300k: bool = False
    save_original_images: bool = False
    resize_images: bool = True
    resized_images_subdirectory: str = "images-resized"
    resize_mode: str = "ShrinkToFit"
    resize_box_size: int = 224
    resize_output_format: str = "jpg"
    resize_compression_quality: int | None = None
    dataset_version: int = 3
    max_retries: int = 15
    max_host_connections: int = 5
    max_total_connections: int = 128
    connections_per_task: int = 1
    #: Deal requests out by their expected bytes instead of by hash; pays where sizes differ and hosts are few.
    schedule_by_size: bool = False
    #: Keep originals in packs with a log of versions (`sinks.packs`) instead of one file each.
    packed: bool = False

    def __post_init__(self) -> None:
        if self.dataset_version not in DATASET_VERSIONS:
            raise ValueError(f"dataset_version must be one of {DATASET_VERSIONS}")
        if self.resize_mode not in RESIZE_MODES:
            raise ValueError(f"resize_mode must be one of {RESIZE_MODES}")
        names = ("resize_box_size", "max_retries", "max_host_connections", "max_total_connections", "connections_per_task")
        for name in names:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        total = self.max_total_connections
        if total & (total - 1):
            raise ValueError("max_total_connections must be a power of two")
