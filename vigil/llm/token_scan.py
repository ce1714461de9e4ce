"""Token counts of documents in flat token files, by a scan for the end-of-document id.

A token file is nothing but ids of fixed width, one document after another,
each closed by the end id: no index, no lengths. Files of any length are read as blocks of
bytes that ignore document borders, each by a task that reads only its byte range; each block is searched for the end id as
one vector comparison. A document may span blocks: the last end before a block,
and the number of ends before it, come from a prefix scan over one small row per
block, so that blocks of one large file are worked by many tasks.

``write_token_files`` makes such files from documents with Spark's own text
writer: ids are big-endian 16-bit numbers, and as the end id 50256 is the bytes
C4 50, a row ends with C4 and the line separator ``P`` (50) completes it.

Defined cases: a null text is an empty document (0 tokens); tokens after a
file's last end id are one document with ``complete`` false; an empty file has
no documents; repeated rows are counted each for itself.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import staged
from vigil.llm.tokens import encoder, vocabulary_path

#: The id that ends a document, and how ids are laid out; bytes of a block (a multiple of the id's width).
END_ID, LAYOUT, WIDTH, BLOCK_BYTES = 50_256, ">u2", 2, 1 << 20
#: Bytes that one task reads, of one or several files; documents per file that is written.
TASK_BYTES, FILE_DOCS = 8 << 20, 20_000
LOG = logging.getLogger(__name__)


def write_token_files(docs: DataFrame, path: str, text: str = "text", vocabulary: str | None = None, file_docs: int = FILE_DOCS) -> None:
    """Writes the ids of every whole text, each document closed by the end id, as flat files under ``path``."""
    voc = vocabulary or vocabulary_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(voc)
        for b in batches:
            rows = [np.array(enc.ids(t or ""), dtype=LAYOUT).tobytes() + END_ID.to_bytes(WIDTH, "big")[:1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    last = chr(END_ID & 255)
    (docs.select(text).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", last).option("maxRecordsPerFile", file_docs).text(path))


def _opened(uri: str):
    """(pyarrow file system, path in it)."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote("s3:" + rest if scheme in ("s3a", "s3n") else uri, safe=":/@"))


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(file, block, data): the files' bytes in blocks, regardless of documents. Files are only listed; blocks are dealt
    to tasks of some ``task_bytes``, which read their byte ranges. A store that Python cannot open is read by Spark
    instead, each file as one row (so of less than 2 GB), with a warning."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")  # no contents
    total, one = files.agg(F.sum("length"), F.min("file")).first()
    cut = F.explode(F.expr(f"sequence(0L, (length - 1) div {block_bytes})")).alias("block")
    try:
        if one is not None:
            store, inside = _opened(one)
            store.open_input_file(inside).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as why:  # a kind of store that pyarrow does not know; other errors are raised
        LOG.warning("%s is read by whole files: %s", path, why)
        whole = spark.read.format("binaryFile").load(path).where("length > 0")
        parts = F.expr(f"transform(sequence(0L, (length - 1) div {block_bytes}), i -> struct(i AS block, substring(content, cast(i * {block_bytes} + 1 AS int), {block_bytes}) AS data))")
        return whole.select(F.col("path").alias("file"), F.explode(parts).alias("x")).select("file", "x.block", "x.data")

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for file, block, length in zip(*(b.column(c).to_pylist() for c in ("file", "block", "length")), strict=True):
                store, inside = _opened(file)
                at = block * block_bytes
                with store.open_input_file(inside) as f:
                    data = f.read_at(min(block_bytes, length - at), at)
                if len(data) != min(block_bytes, length - at):
                    raise OSError(f"{file} is shorter than listed")
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

    # the number of partitions is given, as rows this small would all be merged into one task
    return (files.select("file", "length", cut).repartition(max(1, -(-(total or 0) // task_bytes)))
            .mapInArrow(read, "file string, block bigint, data binary"))


def count_tokens(blocks: DataFrame, end_id: int = END_ID, layout: str = LAYOUT, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, doc_no, start, n_tokens, complete): one row per document, in file order; start and n_tokens count
    ids, the end id not included."""
    per_block = block_bytes // width

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sizes, ends = [], []
            for data in b.column("data"):
                ids = np.frombuffer(data.as_buffer(), dtype=layout)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                                             ["file", "block", "size", "ends"])

    found = blocks.mapInArrow(scan, "file string, block bigint, size bigint, ends array<bigint>")
    found = staged(found.withColumn("ends", F.expr(f"transform(ends, e -> e + block * {per_block})")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    after = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    # the windows see a few numbers per block; the ends of the documents come back by an equi-join
    slim = found.select("file", "block", F.array_max("ends").alias("end"), F.size("ends").alias("n"))
    seams = slim.select("file", "block", F.coalesce(F.max("end").over(before), F.lit(-1)).alias("last"),
                        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("number"), F.count(F.lit(1)).over(after).alias("later"))
    stitched = found.join(seams, ["file", "block"])
    one = F.expr("transform(ends, (e, i) -> struct(number + i AS doc_no, if(i = 0, last, ends[i - 1]) + 1 AS start, e AS stop, true AS complete))")
    rest = F.expr(f"""if(later = 0 AND coalesce(array_max(ends), last) < block * {per_block} + size - 1,
        array(struct(number + size(ends) AS doc_no, coalesce(array_max(ends), last) + 1 AS start, block * {per_block} + size AS stop, false AS complete)),
        array())""")
    return (stitched.select("file", F.explode(F.concat(one, rest)).alias("d"))
            .select("file", "d.doc_no", "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), "d.complete"))
