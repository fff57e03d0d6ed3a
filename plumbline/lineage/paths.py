"""Reading SQL files from a folder and nothing outside it."""

from __future__ import annotations

import os
from pathlib import Path

_RESERVED = {"con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))}


class UnsafePath(ValueError):
    pass


def check_folder(folder: str, allow_symlinks: bool = False) -> Path:
    if ".." in Path(folder).parts or "\0" in folder:
        raise UnsafePath(f"path leads out of its folder: {folder!r}")
    p = Path(folder)
    if not allow_symlinks and p.is_symlink():
        raise UnsafePath(f"a symbolic link: {folder!r}")
    if not p.is_dir():
        raise UnsafePath(f"no folder: {folder!r}")
    return p.resolve()


def check_pattern(pattern: str, extensions: tuple[str, ...] = (".sql",)) -> str:
    if ".." in pattern or pattern.startswith(("/", "\\", "~")) or "\0" in pattern:
        raise UnsafePath(f"pattern leads out of its folder: {pattern!r}")
    if not pattern.endswith(extensions):
        raise UnsafePath(f"pattern must end in one of {extensions}: {pattern!r}")
    return pattern


def check_file(path: Path, base: Path) -> Path:
    if path.is_symlink():
        raise UnsafePath(f"a symbolic link: {path}")
    real = path.resolve()
    if base != real and base not in real.parents:
        raise UnsafePath(f"not under {base}: {path}")
    if path.stem.lower() in _RESERVED:
        raise UnsafePath(f"a reserved name: {path.name}")
    return real


def read_sql_files(folder: str, pattern: str = "*.sql", most_bytes: int = 10 << 20) -> list[tuple[str, str]]:
    """(name, text) of the matching files in order of name; each is opened without following links."""
    base, out = check_folder(folder), []
    for path in sorted(base.glob(check_pattern(pattern))):
        real = check_file(path, base)
        fd = os.open(real, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
        with os.fdopen(fd, encoding="utf-8") as f:
            if os.fstat(f.fileno()).st_size > most_bytes:
                raise UnsafePath(f"larger than {most_bytes} bytes: {path}")
            out.append((path.name, f.read()))
    return out
