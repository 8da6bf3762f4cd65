"""Token counts of documents in flat, unindexed token files, found by their end-of-document identifiers.

A file is nothing but unsigned little-endian identifiers. It is read in blocks of fixed size, each block is
searched for the separator with one vectorised comparison, and gives its number of separators and their first
and last position. A prefix scan over a file's blocks gives each block the number of documents before it and
where the open document began, which stitches documents across block borders, however many blocks they span.

Defined results: two separators in a row are an empty document; an empty file has no documents; tokens after
the last separator are a last document with ``complete`` false; a file whose length is not a whole number of
identifiers is refused. Writing: a null or empty text is a document of no tokens; repeated rows are documents
of their own; a text that spells the separator is ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm.bpe import default_vocabulary, load
from topicloom.llm.common import bound_batches, cut, scratch

BLOCK_BYTES = 4 << 20
DTYPE = "<u2"
EOD = 50_256


def write_files(docs: DataFrame, folder: str, vocabulary: str | None = None, eod: int = EOD) -> DataFrame:
    """Write one flat file for each task's documents; returns file, ordinal and doc_id (written, cut).

    A file is moved into place when it is whole, so a task that is run again leaves one good file.
    """
    vocabulary = vocabulary or default_vocabulary()
    bound_batches(docs.sparkSession)
    where, root = pafs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():06d}.bin"
        part = f"{top}/_{name}.{task.taskAttemptId()}"
        coder, ordinal = load(vocabulary), 0
        if max(coder.size - 1, eod) > np.iinfo(DTYPE).max:
            raise ValueError("the vocabulary does not fit the identifiers of the files")
        narrow = lambda ids: ids.astype(DTYPE).tobytes()
        end = narrow(np.array([eod]))
        with store.open_output_stream(part) as out:
            for batch in batches:
                for t in batch.column(1):
                    for block in coder.plain(t.as_py() or ""):
                        out.write(narrow(np.frombuffer(block, dtype=np.uint32)))
                    out.write(end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], names=["file", "ordinal", "doc_id"])
                ordinal += n
        store.move(part, f"{top}/{name}")

    return cut(docs.select("doc_id", F.col("text").cast("string").alias("t")).mapInArrow(run, f"file string, ordinal long, doc_id {docs.schema['doc_id'].dataType.simpleString()}"))


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """file and length of the flat files in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def scan(spark: SparkSession, folder: str, eod: int = EOD, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, start (token offset), n_tokens and complete of every document in the folder's files."""
    width = np.dtype(dtype).itemsize
    step = block_bytes // width
    files = files_of(spark, folder).where("length > 0")
    if files.where(F.col("length") % width != 0).count():
        raise ValueError("a file's length is not a whole number of identifiers")
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / (step * width)))).alias("block"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{top}/{r['file']}") as f:
                    data = np.frombuffer(f.read_at(min(step * width, r["length"] - r["block"] * step * width), r["block"] * step * width), dtype=dtype)
                ends = np.flatnonzero(data == eod) + r["block"] * step
                some = len(ends) > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]]), pa.array([r["block"]]), pa.array([r["length"] // width]), pa.array([len(ends)]), pa.array([ends[-1] if some else None], pa.int64()), pa.array([ends.astype(np.int64)], pa.list_(pa.int64()))],
                    names=["file", "block", "total", "n", "last", "ends"],
                )

    found = cut(ranges.select("file", "length", "block").mapInArrow(search, "file string, block long, total long, n long, last long, ends array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = found.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open"))
    stitched = found.join(carry, ["file", "block"])
    each = stitched.select("file", "first", "open", "ends", F.posexplode("ends").alias("i", "end"))
    prev = F.when(F.col("i") > 0, F.element_at("ends", F.col("i").cast("int"))).otherwise(F.col("open"))
    whole = each.select("file", (F.col("first") + F.col("i")).alias("ordinal"), (prev + 1).alias("start"), (F.col("end") - prev - 1).alias("n_tokens"), F.lit(True).alias("complete"))
    tail = found.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("total").alias("total"))
    tail = tail.where("start < total").select("file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.union(tail)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens: documents written to flat files, then found again by scanning."""
    folder = scratch(docs.sparkSession, "tokens")
    index = write_files(docs, folder)
    found = scan(docs.sparkSession, folder)
    return index.join(found.drop("complete"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
