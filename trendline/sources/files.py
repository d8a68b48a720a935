"""Files that a task opens on its own."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Tasks get these functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Schemes of addresses that tasks can open as a stream on their own.
STREAM_SCHEMES = ("file", "hdfs", "viewfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss")

ADDRESS = r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(.*)"


def any_case(extension: str) -> str:
    """A file name pattern for an extension, in capitals or not: ``*.[zZ][iI][pP]``."""
    return "*." + "".join(f"[{letter.lower()}{letter.upper()}]" for letter in extension)


def files_below(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """The files in a folder, as Spark lists them; their content is read only where it is used."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", any_case(extension))
    return reader.load(folder)


def check_scheme(folder: str) -> None:
    """An error, before any job starts, for an address that tasks cannot open as a stream."""
    import re

    scheme = re.fullmatch(ADDRESS, folder, re.DOTALL)[1]
    if scheme and scheme not in STREAM_SCHEMES:
        known = ", ".join(STREAM_SCHEMES)
        raise ValueError(f"cannot stream files from {scheme}: addresses; known schemes are {known}")


def arrow_path(address: str):
    """The Arrow file system of an address and the path on it.

    Addresses come from Spark as plain text, so blanks, ``%``, ``#`` and the like stand for
    themselves.
    """
    import re

    from pyarrow import fs

    scheme, authority, path = re.fullmatch(ADDRESS, address, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), path
    scheme = "s3" if scheme in ("s3a", "s3n") else scheme
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return system, f"{base.rstrip('/')}/{path.lstrip('/')}"


def addresses_below(folder: str, extension: str) -> list[str]:
    """The addresses of a folder's files of some extension, in order, listed without a job."""
    from pyarrow import fs

    system, path = arrow_path(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=False))
    ending = f".{extension}"
    paths = [info.path for info in found if info.is_file and info.path.lower().endswith(ending)]
    start = folder.rstrip("/")
    return sorted(f"{start}/{path.rsplit('/', 1)[1]}" for path in paths)


def folder_option(options) -> str:
    """The folder that a data source is asked to load."""
    folder = options.get("path")
    if not folder:
        raise ValueError("load needs the path of a folder")
    check_scheme(folder)
    return folder


def first_places(headers) -> list[str]:
    """All names of all headers, by the first place that they have in any."""
    first: dict[str, int] = {}
    for names in headers:
        for place, name in enumerate(names):
            first[name] = min(place, first.get(name, place))
    return sorted(first, key=lambda name: (first[name], name))


def open_file(uri: str):
    """A seekable stream; nothing is read ahead of its use."""
    system, path = arrow_path(uri)
    return system.open_input_file(path)


def write_file(uri: str, content: bytes, attempt: int) -> None:
    """Puts a file in place in one move, so that a repeated task does no harm."""
    system, path = arrow_path(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{attempt}.draft"
    with system.open_output_stream(draft) as stream:
        stream.write(content)
    system.move(draft, path)


def column_names(header: list[str | None], width: int) -> list[str]:
    """A name for every column of a sheet or file: its heading, or its place where it has none.

    Without a heading, the column in the third place is ``_c2``; repeated headings are numbered from
    2.
    """
    taken: set[str] = set()
    names = []
    for place in range(max(width, len(header))):
        base = (header[place] if place < len(header) else None) or f"_c{place}"
        name, repeat = base, 1
        while name in taken:
            repeat += 1
            name = f"{base}_{repeat}"
        taken.add(name)
        names.append(name)
    return names
