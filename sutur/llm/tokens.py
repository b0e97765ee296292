"""Encoding of a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sutur.llm.bpe import BytePairEncoder, default_path, read_ranks

_ENCODERS: dict[int, BytePairEncoder] = {}
# Texts encoded before a batch is handed on; bounds the ids held at once.
_CHUNK = 500


def _encoder(tokens) -> BytePairEncoder:
    """One encoder per Python worker, built from the broadcast vocabulary."""
    key = tokens.id if hasattr(tokens, "id") else id(tokens)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BytePairEncoder(tokens.value)
    return _ENCODERS[key]


def encode_corpus(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, only_counts: bool = False
) -> DataFrame:
    """Token ids of every text, one row per input row, without special tokens.

    path         ``.tiktoken`` vocabulary on the driver (default: the public byte_bpe_50k); it is
                 read once and broadcast - about a megabyte, independent of the corpus
    only_counts  give ``n_tokens bigint`` instead of ``ids array<int>``

    Null and empty texts have an empty list; blank ones are text. Strings that spell a special
    token are ordinary text. Repeated rows are encoded each; an empty table stays empty. Texts are
    encoded whole. Only the two named columns are read; no shuffle.
    """
    spark = df.sparkSession
    tokens = spark.sparkContext.broadcast(read_ranks(path or default_path()))
    id_type = df.schema[id_column].dataType.simpleString()
    out = f"`{id_column}` {id_type}, " + ("n_tokens bigint" if only_counts else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokens).encode
        for whole in batches:
            for begin in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(begin, _CHUNK)
                ids = [encode(t) for t in batch.column(1).to_pylist()]
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                if only_counts:
                    made: pa.Array = pa.array(sizes)
                else:
                    flat = np.fromiter((i for one in ids for i in one), dtype=np.int32, count=int(sizes.sum()))
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), made], names=[id_column, "n_tokens" if only_counts else "ids"])

    return df.select(id_column, text_column).mapInArrow(run, out)


def decode_ids(ids: list[int], path: str | None = None) -> str:
    """The text of ids again; ids of a whole text give it exactly."""
    tokens = read_ranks(path or default_path())
    return b"".join(tokens[i] for i in ids).decode("utf-8")
