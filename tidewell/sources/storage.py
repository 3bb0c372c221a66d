"""Files behind URIs that pyarrow opens, on the driver and on executors alike."""

from __future__ import annotations

import pyarrow.fs as pafs


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def listed(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the file at path, or of the files below it with one of the endings."""
    fs, root = locate(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        return []
    if info.is_file:
        return [(info.path, info.size)]
    below = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((x.path, x.size) for x in below if x.is_file and x.path.lower().endswith(endings))


def packed(files: list[tuple[str, int]], most: int) -> list[tuple[str, ...]]:
    """Files in groups of at most about `most` bytes, in order."""
    groups: list[list[str]] = []
    size = most + 1
    for path, n in files:
        if size + n > most:
            groups.append([])
            size = 0
        groups[-1].append(path)
        size += n
    return [tuple(g) for g in groups]
