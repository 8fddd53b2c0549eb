"""Files become visible together: a manifest, written last, names what a write has added.

Tasks write under final names that hold the write's id and the attempt, so no two writes or
attempts ever meet.  When all tasks are done, the driver writes ``_manifests/<id>.json`` below the
folder, first under another name and then by one move; readers list the files of the manifests
only.  A job that dies before leaves files that no reader sees.

Appending adds a manifest.  Overwriting adds one that names those it replaces; the files of
replaced manifests are deleted after that, and a crash between leaves files that no reader
sees.  A manifest that another write has replaced stays replaced, so writers may run at the same time:
what an overwriting write did not see when it committed is kept.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs

FOLDER = "_manifests"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a plain path is local."""
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


class Write:
    """One write into a folder; travels to the tasks."""

    def __init__(self, path: str, overwrite: bool = False) -> None:
        self.path, self.overwrite, self.id = path, overwrite, uuid.uuid4().hex

    def name(self, partition: int, attempt: int, number: int, suffix: str) -> str:
        """A name that sorts by partition and number."""
        return f"part-{partition:06d}-{number:04d}-{self.id}-{attempt}{suffix}"

    def commit(self, files: list[str]) -> None:
        """Make ``files`` (relative names) what this write has added, and remove all else it wrote."""
        store, folder = place(self.path)
        replaced = sorted(_live(store, folder)) if self.overwrite else []
        store.create_dir(f"{folder}/{FOLDER}", recursive=True)
        with store.open_output_stream(f"{folder}/{FOLDER}/.{self.id}", compression=None) as out:
            out.write(json.dumps({"files": sorted(files), "replaces": replaced}).encode())
        store.move(f"{folder}/{FOLDER}/.{self.id}", f"{folder}/{FOLDER}/{self.id}.json")
        self._drop(store, folder, keep=set(files))
        for name in replaced:
            for file in _manifest(store, folder, name)["files"]:
                if store.get_file_info(f"{folder}/{file}").type == fs.FileType.File:
                    store.delete_file(f"{folder}/{file}")

    def abort(self) -> None:
        store, folder = place(self.path)
        self._drop(store, folder, keep=set())
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
        if all(i.type == fs.FileType.Directory for i in found) and store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)

    def _drop(self, store: fs.FileSystem, folder: str, keep: set[str]) -> None:
        """Delete own files only: those of attempts that were lost."""
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            own = info.type == fs.FileType.File and f"-{self.id}-" in info.base_name
            if own and info.path.removeprefix(folder.rstrip("/") + "/") not in keep:
                store.delete_file(info.path)


def _manifest(store: fs.FileSystem, folder: str, name: str) -> dict:
    with store.open_input_stream(f"{folder}/{FOLDER}/{name}", compression=None) as file:
        return json.loads(file.read())


def _live(store: fs.FileSystem, folder: str) -> dict[str, dict]:
    """Manifests that no other one replaces."""
    found = store.get_file_info(fs.FileSelector(f"{folder}/{FOLDER}", allow_not_found=True))
    names = [i.base_name for i in found if i.type == fs.FileType.File and i.base_name.endswith(".json")]
    read = {n: _manifest(store, folder, n) for n in names}
    gone = {n for m in read.values() for n in m["replaces"]}
    return {n: m for n, m in read.items() if n not in gone}


def committed(path: str) -> list[str] | None:
    """Relative names of the files that are part of a folder, in order; None if it has no manifests at all."""
    store, folder = place(path)
    if store.get_file_info(f"{folder}/{FOLDER}").type == fs.FileType.NotFound:
        return None
    return sorted(f for m in _live(store, folder).values() for f in m["files"])
