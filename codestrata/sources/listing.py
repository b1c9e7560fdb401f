"""Trees of files listed and read on the executors, hidden and empty files included.

A tree is listed breadth first, one level a round: the folders of a level are dealt over the
tasks, and their entries are written before the next level is listed. Files are read by a table
of their paths, dealt so that tasks get about equal bytes. Neither the paths nor the contents
pass the driver, and a task that is run again lists or reads the same folders and files.

Folders are reached as Arrow's file systems reach them: a local path, one that begins with
``file:``, or a URI of a store. Links to folders are followed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import staged
from codestrata.sources.trees import parse_source_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes and files that a task reads, and bytes it hands on together.
TASK_BYTES = 128 << 20
TASK_FILES = 10_000
BATCH_BYTES = 16 << 20
# Levels below the root; more are taken for a folder that holds a link to itself.
DEEPEST = 256

LISTED = "path string, is_dir boolean, length long"


def opened(root: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a root; local paths are taken as they are written."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if "://" not in root:
        return pa.fs.LocalFileSystem(), root
    return pa.fs.FileSystem.from_uri(root)


def list_tree(spark: SparkSession, root: str, skip: tuple[str, ...] = (".git",)) -> DataFrame:
    """Rows ``path, is_dir, length`` of all that is below a root, which paths begin with.

    Folders named in ``skip`` are listed, but not what they hold. A root without entries gives
    no rows, and one that does not exist is an error.
    """
    root = root.rstrip("/")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                place = base + folder.removeprefix(root)
                found = system.get_file_info(pa.fs.FileSelector(place or "/"))
                names = [folder + "/" + info.base_name for info in found]
                is_dir = [info.type == pa.fs.FileType.Directory for info in found]
                sizes = [None if d else info.size for d, info in zip(is_dir, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(is_dir, pa.bool_()),
                     pa.array(sizes, pa.int64())], ["path", "is_dir", "length"],
                )

    level = spark.createDataFrame([(root,)], "path string")
    levels = []
    while len(levels) < DEEPEST:
        dealt = level.repartition(_tasks(spark), "path") if levels else level
        found = staged(dealt.mapInArrow(entries, LISTED), "listing")
        if found.isEmpty():
            break
        levels.append(found)
        name = F.substring_index("path", "/", -1)
        level = found.where(F.col("is_dir") & ~name.isin(*skip)).select("path")
    else:
        raise ValueError(f"{root} has more than {DEEPEST} levels of folders")
    result = spark.createDataFrame([], LISTED)
    for found in levels:
        result = result.unionByName(found)
    return result


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """Rows ``path, content`` of the files of a table ``path, length`` below a root.

    A file that is gone is an error, one without content an empty row. Files are dealt by
    their paths to as many tasks as their bytes, or their number, ask for; one larger than a
    task's share is read in one piece, as its row is one piece.
    """
    root = root.rstrip("/")
    files, size = paths.agg(
        F.count("*"), F.coalesce(F.sum("length"), F.lit(0))
    ).first()
    tasks = max(1, -(-size // TASK_BYTES), -(-files // TASK_FILES))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        names, data, held = [], [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(data, pa.binary())], ["path", "content"]
            )

        for batch in batches:
            for path in batch.column("path").to_pylist():
                place = base.rstrip("/") + path.removeprefix(root)
                with system.open_input_file(place) as file:
                    content = file.read()
                names.append(path)
                data.append(content)
                held += len(content)
                if held >= BATCH_BYTES:
                    yield batch_of()
                    names, data, held = [], [], 0
        yield batch_of()

    dealt = paths.select("path").repartition(tasks, F.xxhash64("path"))
    return dealt.mapInArrow(contents, "path string, content binary")


def scan_tree_sources(spark: SparkSession, root: str, ending: str = ".java") -> DataFrame:
    """``source_file`` facts of trees laid out as ``root/<owner__name>/...``.

    Unlike Spark's own listing this keeps files and folders whose names begin with ``.`` or
    ``_``, and files of zero length.
    """
    files = list_tree(spark, root).where(~F.col("is_dir") & F.endswith("path", F.lit(ending)))
    return parse_source_files(read_files(files, root), root)
