"""Settings in a TOML file: where the notes and the index are, and who is meant by `me`.

    [sources]
    root = "."              # the folder with memory/ and meetings/
    [data]
    dir = ".index"          # tables of the index; also a path of a shared file system, as "s3a://..."
    [user]
    name = "Linnea Holm"

Paths are relative to the file."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

NAME = "noteloom.toml"
#: The variables that name a settings file, and the folder of the index.
FILE_VARIABLE, DATA_VARIABLE = "NOTELOOM_CONFIG", "NOTELOOM_DATA_DIR"


def find(start: str | None = None) -> Path | None:
    """The file that the variable names (and no other, if it names one), else the nearest one from a folder on upwards, else
    the user's own."""
    named = os.environ.get(FILE_VARIABLE)
    if named:
        return Path(named) if Path(named).is_file() else None
    folder = Path(start or os.getcwd()).resolve()
    near = next((d / NAME for d in (folder, *folder.parents) if (d / NAME).is_file()), None)
    own = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "noteloom" / "config.toml"
    return near or (own if own.is_file() else None)


def settings(path: Path) -> dict:
    """project_root, data_dir and me as a file says; the variable for the index counts before the file."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    for part in ("sources", "data", "user"):
        if not isinstance(found.get(part, {}), dict):
            raise ValueError(f"{path}: [{part}] has to be a table")
    beside = lambda p: p if "://" in p else str((path.parent / p).resolve())
    told = os.environ.get(DATA_VARIABLE) or found.get("data", {}).get("dir")
    return {"project_root": beside(found.get("sources", {}).get("root", ".")), "data_dir": beside(told) if told else None, "me": found.get("user", {}).get("name") or None}
