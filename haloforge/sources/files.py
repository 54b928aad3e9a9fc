"""Opening files in any store that pyarrow knows, from the driver or an executor."""

from __future__ import annotations

from collections.abc import Iterator


def _place(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def exists(path: str) -> bool:
    from pyarrow import fs

    system, inner = _place(path)
    return system.get_file_info(inner).type == fs.FileType.File


def open_file(path: str):
    system, inner = _place(path)
    return system.open_input_file(inner)


def lines(path: str, at_once: int = 1 << 20) -> Iterator[str]:
    """The lines of a text file, read piece by piece."""
    with open_file(path) as f:
        rest = b""
        while piece := f.read(at_once):
            parts = (rest + piece).split(b"\n")
            rest = parts.pop()
            for x in parts:
                yield x.decode("utf-8").rstrip("\r")
        if rest:
            yield rest.decode("utf-8").rstrip("\r")


def numbered(path: str, suffix: str = "") -> list[str]:
    """``name<suffix>``, or ``name.0<suffix>`` or ``name<suffix>.0`` alone if that is there; readers add the further parts by count."""
    for candidate in (f"{path}{suffix}", f"{path}.0{suffix}", f"{path}{suffix}.0", path, f"{path}.0"):
        if exists(candidate):
            return [candidate]
    raise FileNotFoundError(f"none of {path}{suffix}, {path}.0{suffix} and {path}{suffix}.0 is there")


def all_parts(first: str, n: int) -> list[str]:
    """The n files of a set whose first is ``name.0[.ext]``."""
    if n <= 1:
        return [first]
    at = first.rfind(".0")
    return [f"{first[:at]}.{k}{first[at + 2 :]}" for k in range(n)]
