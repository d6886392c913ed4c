"""Small driver-side file helpers: defaults on reading, atomic writing, safe paths and deletion."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any, BinaryIO

#: First bytes of the binary collection format (a fixed value).
MAGIC = b"VDB\x01"


def safe_json_read(path: str | Path, default: Any = None) -> Any:
    """The parsed file, or ``default`` if it is missing or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default


def atomic_write(path: str | Path, data: str | bytes | Iterable[bytes], mend: Callable[[BinaryIO], None] | None = None) -> None:
    """Write beside the target, sync, and rename: readers see the old or the new file. Blocks of bytes are written as they come, and ``mend`` may change what was written."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    raw = data.encode("utf-8") if isinstance(data, str) else data
    blocks = [raw] if isinstance(raw, bytes) else raw
    fd, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            for block in blocks:
                f.write(block)
            if mend is not None:
                mend(f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise


def safe_path(root: str | Path, *parts: str) -> Path:
    """A path below ``root``; ValueError for one that leads out of it."""
    root = Path(root).expanduser().resolve()
    found = root.joinpath(*parts).resolve()
    if found != root and root not in found.parents:
        raise ValueError("path leads out of its folder")
    return found


def safe_name(name: str) -> str:
    """A collection name usable as a file name."""
    if not re.fullmatch(r"[\w.-]+", name) or name.startswith("."):
        raise ValueError(f"not a collection name: {name!r}")
    return name


def ensure_dir(path: str | Path) -> Path:
    path = Path(path)
    path.mkdir(parents=True, exist_ok=True)
    return path


def safe_delete(path: str | Path) -> bool:
    """Delete a file or folder; False if there is none."""
    path = Path(path)
    if path.is_dir():
        shutil.rmtree(path, ignore_errors=True)
        return True
    existed = path.exists()
    path.unlink(missing_ok=True)
    return existed


def detect_format(path: str | Path) -> str:
    """``vdb`` or ``json``, by the first bytes; the extension doesn't matter."""
    with open(path, "rb") as f:
        return "vdb" if f.read(4) == MAGIC else "json"
