"""Files written by tasks, on whatever file system their folder names."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs), and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else path)


@contextmanager
def whole_file(path: str):
    """A stream whose file appears under its name only when it is complete, so repeated tasks leave one whole file."""
    system, place = opened(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part) as out:
            yield out
    except BaseException:
        system.delete_file(part)
        raise
    system.move(part, place)
