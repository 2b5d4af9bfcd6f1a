"""Small JSON files on any file system Spark can reach: manifests and pointers.

A manifest directory holds files ``00000000000000000001.json, …``: one per commit or batch, each
put in place whole. Only this metadata is touched here; table data is read and written by Spark.
"""

import datetime as dt
import json
import os
import uuid

from pyarrow import fs as pafs

_DIGITS = 20


def locate(path: str):
    """File system and path of a local path or a URI."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    for alias in ("s3a://", "s3n://"):
        if path.startswith(alias):
            path = "s3://" + path[len(alias):]
    return pafs.FileSystem.from_uri(path)


def _default(value):
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    raise TypeError(f"cannot store {type(value).__name__}")


class AlreadyThere(RuntimeError):
    """Another writer put the file in place first."""


def write_json(path: str, rows: list[dict], new: bool = False) -> None:
    """Put a file of one JSON object per line in place at once. With ``new`` it must not be there yet: of two
    writers of one manifest the later one fails."""
    fs, target = locate(path)
    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
    temporary = f"{target.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        out.write("".join(json.dumps(r, default=_default) + "\n" for r in rows).encode())
    if not new:
        fs.move(temporary, target)
    elif isinstance(fs, pafs.LocalFileSystem):
        try:
            os.link(temporary, target)  # fails if it is there, unlike a move
        except FileExistsError:
            raise AlreadyThere(path) from None
        finally:
            os.unlink(temporary)
    else:
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            fs.delete_file(temporary)
            raise AlreadyThere(path)
        fs.move(temporary, target)


def read_json(path: str) -> list[dict]:
    fs, target = locate(path)
    with fs.open_input_stream(target) as handle:
        return [json.loads(line) for line in handle.read().decode().splitlines() if line]


def make_dir(path: str) -> None:
    fs, target = locate(path)
    fs.create_dir(target, recursive=True)


def exists(path: str) -> bool:
    fs, target = locate(path)
    return fs.get_file_info(target).type != pafs.FileType.NotFound


def delete(path: str) -> None:
    """Remove a file or folder of ours that no manifest names any more."""
    fs, target = locate(path)
    kind = fs.get_file_info(target).type
    if kind == pafs.FileType.Directory:
        fs.delete_dir(target)
    elif kind == pafs.FileType.File:
        fs.delete_file(target)


def folder_bytes(path: str) -> int:
    """Size of all files below a folder."""
    fs, target = locate(path)
    found = fs.get_file_info(pafs.FileSelector(target, recursive=True, allow_not_found=True))
    return sum(i.size for i in found if i.type == pafs.FileType.File)


def subfolders(path: str) -> list[str]:
    fs, target = locate(path)
    found = fs.get_file_info(pafs.FileSelector(target, allow_not_found=True))
    return sorted(i.base_name for i in found if i.type == pafs.FileType.Directory)


def manifest_path(directory: str, number: int) -> str:
    return f"{directory}/{number:0{_DIGITS}d}.json"


def manifest_numbers(directory: str) -> list[int]:
    """Numbers of the manifests present, ascending."""
    fs, target = locate(directory)
    found = fs.get_file_info(pafs.FileSelector(target, allow_not_found=True))
    names = [i.base_name[:-5] for i in found if i.base_name.endswith(".json")]
    return sorted(int(n) for n in names if n.isdigit())


def present_after(directory: str, number: int, probe: int = 256) -> int:
    """Last number of the unbroken run of manifests after ``number``. Cost follows the new
    manifests, not the history."""
    fs, target = locate(directory)
    while True:
        wanted = [manifest_path(target, n) for n in range(number + 1, number + 1 + probe)]
        for info in fs.get_file_info(wanted):
            if info.type == pafs.FileType.NotFound:
                return number
            number += 1
