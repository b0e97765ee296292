"""Recognisers as plug-ins: batches of line images to frame scores to text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutur.errors import DecodingError
from sutur.functions.sequences import collapse_path, decode, frame_path
from sutur.session import plain_strings
from sutur.sources.pixels import crop, grayscale, image_array, line_input, pad_lines

LOGIT_SCHEMA = "logits array<array<float>>, frames int"


class Recognizer(Protocol):
    """A loaded model: (batch, height, width) lines in -1..1 and their widths to scores and valid frames."""

    def __call__(self, lines: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


_LOADED: dict[str, Recognizer] = {}


def _loaded(token: str, load: Callable[[], Recognizer]) -> Recognizer:
    """The model of a call, loaded once per worker process; only the latest is kept."""
    if token not in _LOADED:
        _LOADED.clear()
        _LOADED[token] = load()
    return _LOADED[token]


def recognize_lines(lines: DataFrame, load: Callable[[], Recognizer], batch_size: int = 16) -> DataFrame:
    """Adds ``logits`` and ``frames`` to rows with ``height int, width int, pixels binary`` (grey line images).

    ``load`` runs once per worker process; batches keep the order of rows. Every line must come back.
    """
    keep = [f for f in lines.schema.fields if f.name != "pixels"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", " + LOGIT_SCHEMA

    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(token, load)
        for rows in batches:
            for begin in range(0, rows.num_rows, batch_size):
                part = rows.slice(begin, batch_size)
                shapes = zip(*(part.column(n).to_pylist() for n in ("pixels", "height", "width")))
                images = [line_input(np.frombuffer(p, np.uint8).reshape(h, w)) for p, h, w in shapes]
                scores, frames = model(*pad_lines(images))
                if len(scores) != part.num_rows or len(frames) != part.num_rows:
                    raise DecodingError("the recogniser must give one result per line")
                logits = pa.array([np.asarray(s).tolist() for s in scores], type=pa.list_(pa.list_(pa.float32())))
                columns = [part.column(f.name) for f in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, logits, pa.array(np.asarray(frames, dtype=np.int32))], names=[*(f.name for f in keep), "logits", "frames"]
                )

    return lines.mapInArrow(run, schema)


def greedy_texts(scored: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Adds ``indices`` and ``text`` by greedy decoding of the valid frames."""
    characters = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    decoded = scored.withColumn("indices", collapse_path(frame_path(F.col("logits"), F.col("frames"))))
    return decoded.withColumn("text", decode(F.col("indices"), characters))


def line_crops(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Grey pixels of every region: pages (page_id, image) with regions (page_id, region_id, x, y, width, height, ...).

    Co-grouped by page, so the pixels of a page are read once for all of its lines.
    """
    extra = [f for f in regions.schema.fields if f.name not in ("width", "height")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra) + ", width int, height int, pixels binary"
    flat = pages.select("page_id", *[F.col(f"image.{n}").alias(f"_{n}") for n in ("height", "width", "nChannels", "data")])

    # Only pages on both sides meet, so no group is empty.
    flat = flat.join(regions.select("page_id").distinct(), "page_id", "left_semi")
    regions = regions.join(pages.select("page_id").distinct(), "page_id", "left_semi")

    def cut(page: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        names = [f.name for f in extra] + ["width", "height", "pixels"]
        p = page.iloc[0]
        gray = grayscale(image_array(int(p["_height"]), int(p["_width"]), int(p["_nChannels"]), p["_data"]))
        lines = lines.copy()
        lines["pixels"] = [crop(gray, x, y, w, h).tobytes() for x, y, w, h in zip(lines["x"], lines["y"], lines["width"], lines["height"])]
        return plain_strings(lines[names])

    return flat.groupBy("page_id").cogroup(regions.groupBy("page_id")).applyInPandas(cut, schema)
