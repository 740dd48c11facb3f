"""Where a project and its stored graph lie."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class StoragePaths:
    project_root: str
    data_dir: str

    @property
    def store(self) -> str:
        return os.path.join(self.data_dir, "graph")

    @property
    def memory(self) -> str:
        return os.path.join(self.data_dir, "memory")


def storage_paths(project_root: str | None = None, storage_root: str | None = None) -> StoragePaths:
    """Arguments come before the environment. Without a storage root the data lie in the project; with one,
    in a folder of it named by the project's slug and a part of the hash of its path."""
    project = os.path.realpath(project_root or os.environ.get("CODELOOM_PROJECT_ROOT") or ".")
    storage = storage_root or os.environ.get("CODELOOM_STORAGE_ROOT")
    if storage is None:
        return StoragePaths(project, os.path.join(project, ".codeloom"))
    slug = re.sub(r"[^a-z0-9]+", "-", os.path.basename(project).lower()).strip("-") or "project"
    digest = hashlib.sha256(project.encode()).hexdigest()[:10]
    return StoragePaths(project, os.path.join(os.path.realpath(storage), f"{slug}-{digest}"))
