"""Binary files in the shared folder, written and read by executors."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator


def open_store(uri: str):
    """The file system of an address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def created(uri: str) -> Iterator:
    """A stream whose file appears under its name once it is whole; an earlier attempt's file is replaced.

    Attempts write under names of their own, so a task that runs again, or twice at
    once, leaves one whole file.
    """
    import uuid

    store, path = open_store(uri)
    folder = path.rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    partial = f"{folder}/.{uuid.uuid4().hex}.partial"
    try:
        with store.open_output_stream(partial) as out:
            yield out
        with contextlib.suppress(FileNotFoundError, OSError):
            if store.type_name != "local":  # a local move replaces
                store.delete_file(path)
        store.move(partial, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError, OSError):
            store.delete_file(partial)
        raise


def read_all(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as file:
        return file.read()


def read_range(uri: str, start: int, length: int) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as file:
        return file.read_at(length, start)


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files of a folder with a suffix, by name; none if there is no such folder."""
    from pyarrow import fs

    store, path = open_store(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f"{uri.rstrip('/')}/{f.base_name}", f.size) for f in found if f.is_file and f.base_name.endswith(suffix) and not f.base_name.startswith("."))
