"""Tables and files written in the shared folder, for steps that read some of their columns or rows again."""

from __future__ import annotations

from paperlens.session import written

__all__ = ["opened", "written"]


def opened(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)
