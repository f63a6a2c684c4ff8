"""Files by path on any file system that Arrow knows, for use inside tasks."""

from __future__ import annotations


def located(path: str):
    """File system and inner path of a plain, unescaped path or URI."""
    from urllib.parse import quote

    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


#: Folders that the listing is spread over, if the tree has as many, and levels that are looked through for them.
SPREAD, LEVELS = 64, 4


def root_of(root: str) -> tuple[str, str]:
    """A folder's URI as Arrow reads it, and the start of the names that Spark gives to files below it."""
    import os

    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        root = "file:" + os.path.abspath(root)
    uri = root if "://" in root else root.replace("file:", "file://", 1)
    system, inner = located(uri)
    return uri, "file:" if isinstance(system, fs.LocalFileSystem) else root[: root.index(inner)]


def _seen(name: str) -> bool:
    """Hidden names are left out as Spark leaves them out."""
    return not name.startswith(".") and not (name.startswith("_") and "=" not in name)


def listed_files(spark, root: str, pattern: str = "*"):
    """Every file under a folder, at any depth: ``path, length``, named as Spark names files; also those of no bytes.

    Only the upper folders, some dozens, are listed here; what lies below them
    is listed by tasks, a folder each.
    """
    from fnmatch import fnmatchcase

    import pyarrow as pa
    from pyarrow import fs

    uri, prefix = root_of(root)
    system, inner = located(uri)
    start = system.get_file_info(inner)
    entries = [start] if start.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    kept = lambda found: [f for f in found if _seen(f.base_name)]
    entries = kept(entries)
    for _ in range(LEVELS):
        folders = [f for f in entries if f.type == fs.FileType.Directory]
        if not folders or len(folders) >= SPREAD:
            break
        entries = [f for f in entries if f.type == fs.FileType.File]
        for folder in folders:
            entries += kept(system.get_file_info(fs.FileSelector(folder.path)))

    def run(batches):
        below, _ = located(uri)
        for batch in batches:
            paths, sizes = [], []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if size is None:
                    found = below.get_file_info(fs.FileSelector(path, recursive=True))
                    files = [f for f in found if f.type == fs.FileType.File and all(map(_seen, f.path[len(path) + 1 :].split("/")))]
                    paths += [f.path for f in files]
                    sizes += [f.size for f in files]
                else:
                    paths.append(path)
                    sizes.append(size)
            named = [i for i, p in enumerate(paths) if fnmatchcase(p.rsplit("/", 1)[-1], pattern)]
            columns = [pa.array([prefix + paths[i] for i in named], pa.string()), pa.array([sizes[i] for i in named], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "length"])

    rows = [(f.path, f.size if f.type == fs.FileType.File else None) for f in entries]
    # a folder is a row, and a row is a task: folders may be of very unlike sizes
    given = spark.createDataFrame(rows, "path string, length bigint")
    return given.repartition(max(1, min(len(rows), 8 * SPREAD))).mapInArrow(run, "path string, length bigint")
