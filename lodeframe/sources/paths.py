"""Files by path or address, local or remote, without a local-only open()."""

from __future__ import annotations

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it: addresses with a scheme by Arrow's file systems, others on this machine or a shared mount."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def joined(path: str, *parts: str) -> str:
    return "/".join([path.rstrip("/"), *parts])


def is_file(path: str) -> bool:
    system, inner = located(path)
    return system.get_file_info(inner).type == fs.FileType.File


def is_folder(path: str) -> bool:
    system, inner = located(path)
    return system.get_file_info(inner).type == fs.FileType.Directory


def listed(path: str) -> list[str]:
    """Names in a folder, sorted; none where it is missing."""
    system, inner = located(path)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)))


def size_of(path: str) -> int:
    system, inner = located(path)
    return system.get_file_info(inner).size


def opened(path: str):
    """A seekable reader."""
    system, inner = located(path)
    return system.open_input_file(inner)


def created(path: str):
    """A writer; folders above are made."""
    system, inner = located(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def renamed(source: str, target: str) -> None:
    system, inner = located(source)
    system.move(inner, located(target)[1])


def removed(path: str) -> None:
    """A file or a folder with all in it; nothing where it is missing."""
    system, inner = located(path)
    kind = system.get_file_info(inner).type
    if kind == fs.FileType.Directory:
        system.delete_dir(inner)
    elif kind == fs.FileType.File:
        system.delete_file(inner)


def text_of(path: str) -> str:
    with opened(path) as file:
        return file.read().decode("utf-8")


def write_bytes(path: str, data: bytes) -> None:
    """Replaced at once."""
    with created(path + ".part") as file:
        file.write(data)
    removed(path)
    renamed(path + ".part", path)
