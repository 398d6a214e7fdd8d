"""Names, thresholds and sizes of the catalogue. Every operator takes them as parameters; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Names with a meaning of their own.
UNASSIGNED = "_NO_FACE_ASSIGNED_"
SOFT_IGNORE_API = ".ignore"
HARD_IGNORE_API = ".realignore"
SOFT_IGNORE_CLASSIFIER = ".another_ignore"

#: What stands for a missing number.
NO_GPS = -999.0
NO_ENCODING = -999.0
NO_VALUE = -1
NO_ORIENTATION = -8008


@dataclass(frozen=True)
class Settings:
    """Parameters of a catalogue."""

    time_zone: str = "UTC"
    ignored_names: tuple[str, ...] = (UNASSIGNED, SOFT_IGNORE_API, HARD_IGNORE_API, SOFT_IGNORE_CLASSIFIER)
    excluded_names: tuple[str, ...] = ()
    similarity_threshold: float = 0.6
    percentile: float = 0.99
    n_candidates: int = 5
    min_faces: int = 10
    box_threshold: float = 0.3
    tile_cuts: tuple[int, ...] = (1, 3)
    tile_overlap: float = 0.06
    outlier_factor: float = 2.0
    images_per_hour: float = 1600.0
    page_size: int = 100
    chip_pad: float = 0.4
    chip_max: int = 800
    thumbnail_sizes: tuple[int, ...] = field(default=(500, 250, 100))


DEFAULTS = Settings()
