"""ZIP backups of a data folder. Archives are single files of one machine, so this runs on the driver."""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile
from datetime import datetime
from pathlib import Path

BACKUPS = "backups"


def create(root: str | Path, prefix: str, now: datetime) -> Path:
    """A new archive of everything under root except the backups; half-written archives never carry the final name."""
    root = Path(root)
    folder = root / BACKUPS
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / f"{prefix}{now:%Y%m%d-%H%M%S}.zip"
    part = target.with_suffix(".part")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*")):
            inner = path.relative_to(root)
            if path.is_file() and not path.is_symlink() and inner.parts[0] != BACKUPS:
                archive.write(path, inner.as_posix())
    part.replace(target)
    return target


def checked_members(archive: zipfile.ZipFile, root: Path) -> list[zipfile.ZipInfo]:
    """The archive's entries; one that would land outside root is an error."""
    base = root.resolve()
    for info in archive.infolist():
        if not (base / info.filename).resolve().is_relative_to(base):
            raise ValueError(f"{info.filename} leaves the folder")
    return archive.infolist()


def restore(archive: str | Path, root: str | Path) -> None:
    """Replaces everything under root except the backups. The archive is unpacked and checked first, and a failure puts the old data back."""
    root = Path(root)
    with tempfile.TemporaryDirectory(dir=root.parent) as scratch:
        fresh, old = Path(scratch, "new"), Path(scratch, "old")
        fresh.mkdir()
        old.mkdir()
        with zipfile.ZipFile(archive) as z:
            for info in checked_members(z, fresh):
                z.extract(info, fresh)
        shutil.rmtree(fresh / BACKUPS, ignore_errors=True)
        moved: list[str] = []
        try:
            for name in os.listdir(root):
                if name != BACKUPS:
                    shutil.move(root / name, old / name)
                    moved.append(name)
            for name in os.listdir(fresh):
                shutil.move(fresh / name, root / name)
        except OSError:
            for name in moved:
                shutil.rmtree(root / name, ignore_errors=True)
                shutil.move(old / name, root / name)
            raise


def import_archive(source: str | Path, root: str | Path, now: datetime) -> Path:
    """A copy of a foreign archive among the backups, if it is one and stays inside the folder."""
    with zipfile.ZipFile(source) as z:
        checked_members(z, Path(root))
        if (bad := z.testzip()) is not None:
            raise ValueError(f"{bad} is damaged")
    folder = Path(root) / BACKUPS
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / f"imported-{now:%Y%m%d-%H%M%S}.zip"
    part = target.with_suffix(".part")
    shutil.copyfile(source, part)
    part.replace(target)
    return target


def room_for(size: int, free: int, least: int = 256 << 20, share: int = 5) -> bool:
    """Does a copy leave the reserve free?"""
    return free >= size + max(least, size // share)


def tree_size(path: str | Path) -> int:
    """Bytes of a file or folder; symbolic links count nothing."""
    path = Path(path)
    if path.is_symlink() or not path.exists():
        return 0
    return path.stat().st_size if path.is_file() else sum(tree_size(p) for p in path.iterdir())
