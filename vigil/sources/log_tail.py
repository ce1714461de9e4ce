"""A stream source that follows growing log files.

Spark's file source reads a file once, whole; a live log grows in place. This
source's offset holds, for every file of a directory, the byte after its last
finished line. A trigger reads only the bytes between two offsets, in blocks
that several tasks read; an unfinished last line is held back until its end is
written, and no line is read twice. A file that has become shorter was started
anew and is read from its start.

Files are opened with ``pyarrow.fs`` by every task, so the directory must be
one that all executors reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMAT = "log_tail"
#: Bytes of a file that one task reads, and bytes looked at in one go.
BLOCK_BYTES, READ_BYTES = 32 << 20, 1 << 20


def _source():
    # made here, so that executors get the classes by value and need no installed package
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    block_bytes, read_bytes, name_ = BLOCK_BYTES, READ_BYTES, FORMAT

    def opened(path):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)

    class Block(InputPartition):
        def __init__(self, file, lo, hi):
            self.file, self.lo, self.hi = file, lo, hi

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.path, self.suffix = options["path"], options.get("suffix", "")
            self.block = int(options.get("blockBytes", block_bytes))

        def initialOffset(self):
            return {}

        def latestOffset(self, *_):
            from pyarrow import fs

            store, root = opened(self.path)
            out = {}
            for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if f.is_file and f.path.endswith(self.suffix):
                    out[f.path] = self.finished(store, f.path, f.size)
            return out

        def finished(self, store, path, size):
            """The byte after the last line end."""
            with store.open_input_file(path) as f:
                hi = size
                while hi > 0:
                    lo = max(0, hi - read_bytes)
                    f.seek(lo)
                    at = f.read(hi - lo).rfind(b"\n")
                    if at >= 0:
                        return lo + at + 1
                    hi = lo
            return 0

        def partitions(self, start, end):
            out = []
            for file, hi in sorted(end.items()):
                lo = start.get(file, 0)
                lo = lo if lo <= hi else 0  # started anew
                out += [Block(file, at, min(at + self.block, hi)) for at in range(lo, hi, self.block)]
            return out

        def read(self, partition):
            import pyarrow as pa

            store, _ = opened(self.path)
            names = ["file", "at", "line"]
            with store.open_input_file(partition.file) as f:
                at, held = partition.lo, b""
                if at > 0:  # a line belongs to the block in which it starts
                    f.seek(at - 1)
                    while (got := f.read(read_bytes)) and (cut := got.find(b"\n")) < 0:
                        at += len(got)
                    if not got:
                        return
                    at += cut
                f.seek(at)
                while at < partition.hi and (got := f.read(read_bytes)):
                    held += got
                    *lines, held = held.split(b"\n")
                    starts, texts = [], []
                    for line in lines:
                        if at >= partition.hi:
                            break
                        starts.append(at)
                        texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                        at += len(line) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], names)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name_

        def schema(self):
            return "file string, at bigint, line string"

        def streamReader(self, schema):
            return Reader(self.options)

    return Source


def follow(spark: SparkSession, directory: str, suffix: str = "", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The finished lines of all files below ``directory``, now and as they grow: (file, at, line), ``at`` the line's first byte."""
    spark.dataSource.register(_source())
    return spark.readStream.format(FORMAT).option("path", directory).option("suffix", suffix).option("blockBytes", block_bytes).load()
