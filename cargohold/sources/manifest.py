"""The fixed manifest of metadata archives, one row per stored artifact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargohold.config import DATASET_VERSIONS
from cargohold.schemas import MANIFEST

# Published archives of the three dataset releases.
BASE_URI = "https://storage.googleapis.com/openimages"

TOP_DIRS = {1: "images_2016_08", 2: "2017_07", 3: "2017_11"}
FOLDERS = {1: "2016_08", 2: "2017_07", 3: "2017_11"}

# (version, role, archive stem, description, tar.gz size, tar.gz md5, tar size, tar md5)
ARCHIVES = [
    (1, "images", "images_2016_08_v5", "Image URLs and metadata",
     1038144161, "0e47566d03759f0b69cf4a3fba29592c", 3362037760, "a95622f4cd44b2f52309e4cb1cea5452"),
    (1, "other", "machine_ann_2016_08_v3", "Machine image-level annotations (train and validation sets)",
     470893902, "48a2b164a2998f4da5a78be5655bc1fb", 3137187840, "2c5adb88c6eee9e7c387e38f458bfb48"),
    (1, "other", "human_ann_2016_08_v3", "Human image-level annotations (validation set)",
     9718729, "ac549b4cc3179309a7b41b81e96c07dc", 63856640, "f34ba48526492c52e9ea2a7577f7a7fb"),
    (2, "images", "images_2017_07", "Image URLs and metadata",
     1038132176, "9c7d7d1b9c19f72c77ac0fa8e2695e00", 3362037760, "bff4cdd922f018f343e53e2ffea909f2"),
    (2, "other", "annotations_human_bbox_2017_07", "Bounding box annotations (train, validation, and test sets)",
     38732419, "3c57bff20c56e50025e16562c4c0d709", 141342720, "927db28263ee14c741d2e7c08cdd15c7"),
    (2, "other", "annotations_human_2017_07", "Human-verified image-level annotations (train, validation, and test sets)",
     69263638, "27610fb9d349b728448507beec244e9f", 415528960, "31f0e58103335281d8413a67bfd526b9"),
    (2, "other", "annotations_machine_2017_07", "Machine-generated image-level annotations (train, validation, and test sets)",
     468937924, "c19b3fc5059ac13431b085c3e5df08af", 3127920640, "7825a907b569ccd3df88002936bead68"),
    (2, "other", "classes_2017_07", "Classes and class descriptions",
     300021, "a51205f02faf3867ae2d3e8dc968fd6d", 727040, "20f621858305d3d56a1607a64ace4dcc"),
    (3, "images", "images_2017_11", "Image URLs and metadata",
     1038133015, "d840296342470becab9db7228bda86cc", 3362037760, "8157f623bfe27027601af228c3ba999d"),
    (3, "other", "annotations_human_bbox_2017_11", "Bounding box annotations (train, validation, and test sets)",
     102011131, "427faa2f208ab358bed6a7f380a99493", 341913600, "532c71692b54c44ee9860fe400cbac8b"),
    (3, "other", "annotations_human_2017_11", "Human-verified image-level annotations (train, validation, and test sets)",
     144102834, "cdcbb5e9aba900530c85cb370564f599", 973137920, "7f38f44c9e4e33688dbb1ab3d014223f"),
    (3, "other", "annotations_machine_2017_11", "Machine-generated image-level annotations (train, validation, and test sets)",
     468938323, "493e0e17f8bbb1dd1bf778b24aa11a84", 3127920640, "11fb4ac3d600548f58f660a67202ac6f"),
    (3, "other", "classes_2017_11", "Classes and class descriptions",
     303055, "3937f6dddf777ca912c816d5f6ffe06f", 747520, "b46363532cbc22a975933f4af4aede43"),
]


def _rows() -> list[tuple]:
    rows = []
    for version, role, stem, description, gz_size, gz_md5, tar_size, tar_md5 in ARCHIVES:
        uri = f"{BASE_URI}/{FOLDERS[version]}/{stem}.tar.gz"
        head = (version, TOP_DIRS[version], role, description, uri)
        rows.append((*head, "tar.gz", f"{stem}.tar.gz", gz_size, gz_md5))
        rows.append((*head, "tar", f"{stem}.tar", tar_size, tar_md5))
    return rows


def check_version(version: int) -> int:
    if version not in DATASET_VERSIONS:
        raise ValueError(f"unknown dataset version {version}, expected one of {DATASET_VERSIONS}")
    return version


def top_dir(version: int) -> str:
    return TOP_DIRS[check_version(version)]


def manifest(spark: SparkSession, version: int | None = None) -> DataFrame:
    """All artifact rows, or those of one version."""
    rows = _rows()
    if version is not None:
        rows = [row for row in rows if row[0] == check_version(version)]
    return spark.createDataFrame(rows, MANIFEST)
