"""Token-ID output: documents encoded in ascending id order into shard files, each one wavelet matrix."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekit.llm.arrays import blocks
from tablekit.llm.tokens import encoder, tokenizer_text
from tablekit.llm.wavelet import WaveletMatrix, encode_file
from tablekit.llm.work import new_path, text_columns

#: Tokens after which a shard is closed; a longer document still lies in one shard.
SHARD_TOKENS = 1 << 20
_SHARD = "part int, seq int, first_doc_id long, n_docs long, start_in_part long, n_tokens long, file binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 0,
                      shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode `text` of every row, append `end_id` to each, and write the ids in ascending doc_id order.

    `path` gets a Parquet table of shard files: `part` and `seq` order them, `file` is the wavelet matrix file. Rows are
    range-partitioned by doc_id, so no task holds more than its range; a task keeps one shard in memory at a time.
    Null text is empty (the end id alone); a null doc_id sorts first; equal rows lie side by side; an empty table gives no
    shard. Special tokens are not added, but their strings in a text are encoded as the library does by default.
    """
    tokenizer = tokenizer_text(tokenizer_path)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []
        held = done = 0

        def closed() -> pa.RecordBatch:
            empty = np.array([x is None for x in names])
            file = encode_file(np.concatenate(ids), np.array([x or 0 for x in names], np.int64), empty, np.cumsum(sizes))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                                               "first_doc_id": pa.array([names[0]], pa.int64()), "n_docs": pa.array([len(names)], pa.int64()), "start_in_part": pa.array([done], pa.int64()),
                                               "n_tokens": pa.array([held], pa.int64()), "file": pa.array([file], pa.binary())})

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                tokens, counts = encode.encode(block)
                ends = np.cumsum(counts)
                with_end = np.insert(tokens, ends, np.uint32(end_id))
                counts = counts + 1
                ends = np.cumsum(counts)
                first, begin = 0, 0
                while first < len(counts):
                    last = min(len(counts), first + max(1, int(np.searchsorted(ends[first:] - begin, shard_tokens - held, "right"))))
                    ids.append(with_end[begin:ends[last - 1]])
                    names += doc_ids[block.first + first:block.first + last]
                    sizes += counts[first:last].tolist()
                    held += int(ends[last - 1]) - begin
                    first, begin = last, int(ends[last - 1])
                    if held >= shard_tokens or first < len(counts):
                        yield closed()
                        seq, ids, names, sizes, held, done = seq + 1, [], [], [], 0, done + held
        if names:
            yield closed()

    ordered = (text_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(shards, _SHARD).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, decoded from its shard file: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before; the driver gathers one total per range partition for it, no more.
    `ids_crc32` is over the ids as little-endian unsigned 32-bit integers, the end id included.
    """
    files = spark.read.parquet(path)
    starts: dict[int, int] = {}
    total = 0
    for row in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        starts[row.part] = total
        total += row.n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, file in zip(*(batch.column(k).to_pylist() for k in range(3))):
                shard = WaveletMatrix(file)
                raw = shard.tokens().astype("<u4").tobytes()
                ends = shard.doc_ends
                begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                crc = [zlib.crc32(memoryview(raw)[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_null), "start": pa.array(begins + (starts[part] + before), pa.int64()),
                    "n_tokens": pa.array(ends - begins, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return files.select("part", "start_in_part", "file").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path)
    return read_token_files(docs.sparkSession, path)
