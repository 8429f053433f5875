"""Version of an installation from its TOML project file."""

from __future__ import annotations

import tomllib
from functools import lru_cache

UNKNOWN = "desconocida"


@lru_cache(maxsize=None)
def project_version(path: str) -> str:
    """``project.version`` of the file, UNKNOWN if it can't be read; each path is read once."""
    try:
        with open(path, "rb") as f:
            return str(tomllib.load(f)["project"]["version"])
    except (OSError, KeyError, TypeError, tomllib.TOMLDecodeError):
        return UNKNOWN
