"""Thresholds of the near-duplicate pipelines and the limits that steer their execution."""

from __future__ import annotations

from dataclasses import dataclass

# Default thresholds, the slack of the suspect band and the size above which a group is split.
DEFAULT_PHASH_THRESHOLD = 8
DEFAULT_COSINE_THRESHOLD = 0.93
SUSPECT_SLACK = 4
MAX_GROUP_SIZE = 20


@dataclass(frozen=True)
class DedupConfig:
    """User thresholds; everything else is derived from them.

    The three ``*_limit`` fields never change a result. They only decide which of two equivalent
    executions is used: one bounded task per component or distributed rounds.
    """

    phash_threshold: int = DEFAULT_PHASH_THRESHOLD
    cosine_threshold: float = DEFAULT_COSINE_THRESHOLD
    max_group_size: int = MAX_GROUP_SIZE
    component_edge_limit: int = 500_000
    chunk_rows: int = 512
    split_point_limit: int = 8_000

    @property
    def suspect_max(self) -> int:
        return self.phash_threshold + SUSPECT_SLACK

    @property
    def max_ingroup_phash(self) -> int:
        return self.phash_threshold + SUSPECT_SLACK

    @property
    def split_phash(self) -> int:
        return self.phash_threshold // 2

    @property
    def split_cosine(self) -> float:
        return self.cosine_threshold + (1.0 - self.cosine_threshold) * 0.5
