"""Token counts of flat token files, by scanning for separators.

A flat token file is nothing but token identifiers of a fixed width, one document after the other,
each closed by the end-of-document identifier; there is no index. Files are read in blocks that know
nothing of document borders. Each block is searched for the identifier in one vectorised step; a
document that runs over block ends is closed by the first separator of a later block, found by a
scan over one row per block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from changerisk.llm.blocks import cut
from changerisk.llm.shared import stored
from changerisk.session import work_folder

#: A public byte-level vocabulary; its path is a parameter. The identifier after its last one is free.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
#: Bytes of an identifier, and of a block.
WIDTH = 2
BLOCK = 1 << 20
#: Identifiers that open a document written here: whether it has an id, and the id, 13 bits each.
HEADER = 6
_BITS = 13
#: Fixed value: how the vocabulary's texts were split before pairs were merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_TYPES = {2: "<u2", 4: "<u4"}


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _heads(ids: pa.Array) -> np.ndarray:
    """Header of each id; a null id is all zeros."""
    out = np.zeros((len(ids), HEADER), _TYPES[WIDTH])
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    value = ids.drop_null().to_numpy().view(np.uint64)
    out[known, 0] = 1
    for k in range(HEADER - 1):
        out[known, 1 + k] = (value >> np.uint64(_BITS * k)) & np.uint64((1 << _BITS) - 1)
    return out


def _ids(heads: np.ndarray) -> list[int | None]:
    value = np.zeros(len(heads), np.uint64)
    for k in range(HEADER - 1):
        value |= heads[:, 1 + k].astype(np.uint64) << np.uint64(_BITS * k)
    return [v if known else None for v, known in zip(value.view(np.int64).tolist(), heads[:, 0].tolist(), strict=True)]


def write_token_files(docs: DataFrame, path: str, vocabulary: dict[bytes, int] | None = None) -> None:
    """Tokenise ``docs`` into flat files under ``path``, in Spark's own file systems.

    A document is a header with its ``doc_id``, its identifiers and the end of document. A null text
    has no identifiers of its own.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary() if vocabulary is None else vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            heads = _heads(batch["doc_id"])
            for lo, hi in cut(texts):
                yield pa.RecordBatch.from_pydict({"value": [h.tobytes() + np.array(coder.encode_ordinary(t), _TYPES[WIDTH]).tobytes() for h, t in zip(heads[lo:hi], texts[lo:hi], strict=True)]})

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "value binary")
    # The text writer puts its separator after each row and nothing else: that is the flat format.
    end = np.array([END_OF_DOCUMENT], _TYPES[WIDTH]).tobytes().decode("latin-1")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def read_blocks(spark: SparkSession, path: str, width: int = WIDTH, block: int = BLOCK, ahead: int = 0) -> DataFrame:
    """file, size, start, data: each file in blocks of bytes, with ``ahead`` identifiers of the next.

    A file is read as one row, so files are to be of the size that Spark writes; the blocks of a file
    are cut inside its task.
    """
    block -= block % width
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))
    piece = lambda o: F.struct(o.alias("start"), F.substring("content", (o + 1).cast("int"), F.lit(block + ahead * width)).alias("data"))
    cut = files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.explode(F.transform(starts, piece)).alias("b"))
    return cut.select("file", "size", "b.start", "b.data")


def scan(blocks: DataFrame, width: int = WIDTH, end: int = END_OF_DOCUMENT, block: int = BLOCK, header: int = 0) -> DataFrame:
    """file, begin, n_tokens, closed, head: one row per document of the files.

    ``begin``: place of its first identifier in the file; ``n_tokens``: identifiers without header
    and separator; ``head``: the header's bytes. Two separators in a row enclose an empty document.
    What follows the last separator is a document that is not closed; nothing after it is none. A
    rest of a file shorter than an identifier is ignored.
    """
    block -= block % width

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, size, start, data in zip(part["file"], part["size"], part["start"], part["data"], strict=True):
                ids = np.frombuffer(data, _TYPES[width], len(data) // width)
                own = min(block, size - start) // width
                ends = np.flatnonzero(ids[:own] == end)
                begins = ends + 1 if start else np.concatenate(([0], ends + 1))
                closes = ends[1:] if start else ends
                close = np.full(len(begins), -1, np.int64)
                close[: len(closes)] = closes
                place = start // width
                if len(begins):
                    heads = [ids[b : b + header].tobytes() for b in begins]
                    yield pd.DataFrame({"file": file, "start": start, "size": size // width, "begin": begins + place, "end": np.where(close < 0, -1, close + place), "first": -1, "head": heads})
                # One row per block: its first separator.
                yield pd.DataFrame({"file": [file], "start": [start], "size": [size // width], "begin": [-1], "end": [-1], "first": [ends[0] + place if len(ends) else -1], "head": [b""]})

    found = stored(blocks.mapInPandas(search, "file string, start long, size long, begin long, end long, first long, head binary"))
    later = Window.partitionBy("file").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    firsts = found.where("begin < 0").select("file", "start", F.min(F.when(F.col("first") >= 0, F.col("first"))).over(later).alias("next"))
    rows = found.where("begin >= 0")
    # Only a block's last document can be open at its end.
    inner = rows.where("end >= 0").select("file", "size", "begin", "end", "head")
    open_ = rows.where("end < 0").join(firsts, ["file", "start"]).select("file", "size", "begin", F.col("next").alias("end"), "head")
    stitched = inner.unionByName(open_).where("end is not null or begin < size")
    return stitched.select("file", "begin", (F.coalesce("end", "size") - F.col("begin") - header).alias("n_tokens"), F.col("end").isNotNull().alias("closed"), "head")


def count_tokens(docs: DataFrame, vocabulary: dict[bytes, int] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens: ``docs`` written as flat token files, and those scanned.

    Rows that repeat are documents each; null ids stay null; an empty table gives no documents.
    """
    spark = docs.sparkSession
    path = work_folder(spark)
    write_token_files(docs, path, vocabulary)
    found = scan(read_blocks(spark, path, block=block, ahead=HEADER), block=block, header=HEADER)

    def named(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            heads = np.frombuffer(b"".join(part["head"]), _TYPES[WIDTH]).reshape(-1, HEADER)
            yield pd.DataFrame({"doc_id": pd.array(_ids(heads), "Int64"), "n_tokens": part["n_tokens"]})

    return found.select("head", "n_tokens").mapInPandas(named, "doc_id long, n_tokens long")
