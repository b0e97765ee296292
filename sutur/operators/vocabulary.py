"""Character vocabularies: build, look up, encode, decode, compare."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sutur.errors import VocabularyError
from sutur.functions.fingerprints import canonical_json
from sutur.functions.text import characters

NORMALIZATION_POLICY = "nfc-v1"
#: Largest vocabulary taken to the driver: all of Unicode fits.
MOST_CHARACTERS = 1_114_112


def distinct_characters(samples: DataFrame) -> DataFrame:
    """Column ``ch`` of the distinct code points of all texts; partial aggregation before the shuffle."""
    return samples.select(F.explode(characters(F.col("text"))).alias("ch")).distinct()


def build_vocabulary(samples: DataFrame) -> DataFrame:
    """(idx, ch) from 1 on in code-point order; 0 stays free for the blank. At most one row per code point."""
    from pyspark.sql import Window

    return distinct_characters(samples).select(F.row_number().over(Window.orderBy("ch")).alias("idx"), "ch")


def vocabulary_list(vocabulary: DataFrame) -> list[str]:
    """The characters in order of index; bounded by the number of code points."""
    return [r.ch for r in vocabulary.orderBy("idx").limit(MOST_CHARACTERS).collect()]


def unseen_characters(samples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Characters of the texts that the vocabulary lacks, in code-point order."""
    return distinct_characters(samples).join(F.broadcast(vocabulary.select("ch")), "ch", "left_anti").orderBy("ch")


def encode_texts(samples: DataFrame, vocabulary: list[str], strict: bool = True) -> DataFrame:
    """Adds ``indices array<int>``. A text with an unknown character has null, or fails if strict.

    The code points of the vocabulary are broadcast once, at most four bytes for every code point there
    is, and looked up by binary search for all characters of a batch together.
    """
    order = sorted(range(len(vocabulary)), key=lambda i: ord(vocabulary[i]))
    points = np.array([ord(vocabulary[i]) for i in order], dtype=np.uint32)
    shared = samples.sparkSession.sparkContext.broadcast((points, np.array(order, dtype=np.int32) + 1))

    @F.pandas_udf(ArrayType(IntegerType()))
    def lookup(texts: pd.Series) -> pd.Series:
        known, index = shared.value
        lengths = [len(t) if t is not None else 0 for t in texts]
        codes = np.frombuffer("".join(t for t in texts if t is not None).encode("utf-32-le"), dtype=np.uint32)
        place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
        sound = known[place] == codes if len(known) else np.zeros(len(codes), dtype=bool)
        found = index[place] if len(known) else codes
        ends = np.cumsum(lengths)
        rows = [(e - n, e) for n, e in zip(lengths, ends)]
        return pd.Series([None if t is None or not sound[a:b].all() else found[a:b].tolist() for t, (a, b) in zip(texts, rows)], dtype=object)

    out = samples.withColumn("indices", lookup("text"))
    if strict:
        from sutur.guards import require_all

        require_all(out, F.col("indices").isNotNull() | F.col("text").isNull(), ["text"], VocabularyError, "unknown character")
    return out


def vocabulary_record(vocabulary: list[str]) -> dict[str, object]:
    """The canonical record of a vocabulary with its fingerprint."""
    if not vocabulary or any(len(ch) != 1 for ch in vocabulary) or sorted(set(vocabulary)) != vocabulary:
        raise VocabularyError("a vocabulary needs unique single characters in code-point order")
    record: dict[str, object] = {
        "schema_version": 1,
        "normalization_policy_version": NORMALIZATION_POLICY,
        "blank_index": 0,
        "characters": vocabulary,
    }
    return record | {"fingerprint": hashlib.sha256(canonical_json(record, newline=False)).hexdigest()}
