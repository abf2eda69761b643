"""Files that tasks open by themselves at an offset, in any store that pyarrow's file systems reach."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a local path."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def names(path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what a folder holds, in order of names."""
    where, inside = located(path)
    found = where.get_file_info(fs.FileSelector(inside))
    return sorted((f.base_name, f.type == fs.FileType.Directory) for f in found)


def is_folder(path: str) -> bool:
    where, inside = located(path)
    kind = where.get_file_info(inside).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return kind == fs.FileType.Directory


def read_at(path: str, offset: int, size: int) -> bytes:
    """``size`` bytes from ``offset`` on; fewer are an error."""
    where, inside = located(path)
    with where.open_input_file(inside) as f:
        f.seek(offset)
        data = f.read(size)
    if len(data) != size:
        raise ValueError(f"{path}: ends before byte {offset + size}")
    return data


def size_of(path: str) -> int:
    where, inside = located(path)
    info = where.get_file_info(inside)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


@contextmanager
def replaced(path: str):
    """A stream to a new file that takes ``path``'s place when it is complete, so a lost task leaves no half of one."""
    where, inside = located(path)
    where.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    draft = f"{inside}.{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as out:
        yield out
    where.move(draft, inside)
