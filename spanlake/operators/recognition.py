"""What surrounds text recognition: contrast, the choice of rotation, boxes back on the page, and clean lines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of the recognised raster for each point of the page, and of the redacted page.
SCALE, OUTPUT_SCALE = 4, 3


WORDS = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>"


class Engine(Protocol):
    """Reads words off images. It is made once in each Python worker by open()."""

    def open(self) -> None: ...

    def read(self, grey: bytes, width: int) -> list[dict]:
        """Words (text, x0, y0, x1, y1, confidence from 0 to 1) of an image of one byte a pixel."""
        ...


class Columns:
    """A stand-in for tests: each row of pixels is a word, named by its bytes, as sure as its mean is dark."""

    def open(self) -> None:
        pass

    def read(self, grey: bytes, width: int) -> list[dict]:
        rows = np.frombuffer(grey, np.uint8).reshape(-1, width)
        return [{"text": r.tobytes().hex(), "x0": 0.0, "y0": float(y), "x1": float(width), "y1": y + 1.0, "confidence": float(255 * width - r.sum(dtype=np.int64)) / (255 * width)} for y, r in enumerate(rows)]


def recognise(images: DataFrame, engine: Engine, grey: str = "grey", width: str = "width") -> DataFrame:
    """images (a byte for each pixel of `grey`, rows of `width` pixels) with words; a null or empty image has none."""

    @F.pandas_udf(WORDS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        engine.open()
        for data, wide in batches:
            yield pd.Series([engine.read(bytes(b), int(w)) if b else [] for b, w in zip(data, wide, strict=True)], dtype=object)

    return images.withColumn("words", run(F.col(grey), F.col(width)))


def black_out_images(images: DataFrame, boxes: str = "boxes", data: str = "data", width: str = "width", scale: float = 1.0) -> DataFrame:
    """images (bytes of RGB rows of `width` pixels) whose boxes (points, from the top left) are black; null boxes: none."""

    @F.pandas_udf("binary")
    def run(raw: pd.Series, wide: pd.Series, all_boxes: pd.Series) -> pd.Series:
        def one(b, w, found):
            if b is None:
                return None
            image = np.frombuffer(b, np.uint8).reshape(-1, int(w), 3)
            return black_out(image, [(x["x"], x["y"], x["width"], x["height"]) for x in (found if found is not None else ())], scale).tobytes()

        return pd.Series([one(*x) for x in zip(raw, wide, all_boxes, strict=True)], dtype=object)

    return images.withColumn(data, run(F.col(data), F.col(width), F.col(boxes)))


def stretch(rgb: np.ndarray) -> np.ndarray:
    """Grey values of an image (..., 3), stretched to the full range; darker ones darker, lighter ones lighter."""
    red, green, blue = (rgb[..., k].astype(np.float64) for k in range(3))
    grey = red * 0.299 + green * 0.587 + blue * 0.114  # not `@`, which may fuse steps, so that halves round otherwise
    if not grey.size:
        return grey.astype(np.uint8)
    low = grey.min()
    level = (grey - low) / ((grey.max() - low) or 1) * 255
    return np.rint(np.where(level < 128, level * 0.6, np.minimum(255, level * 1.3))).astype(np.uint8)


def black_out(image: np.ndarray, boxes: list[tuple[float, float, float, float]], scale: float = OUTPUT_SCALE) -> np.ndarray:
    """The raster with boxes (points, from the top left) filled with black; edges go outwards."""
    out = image.copy()
    for x, y, w, h in boxes:
        out[max(0, int(np.floor(y * scale))) : max(0, int(np.ceil((y + h) * scale))), max(0, int(np.floor(x * scale))) : max(0, int(np.ceil((x + w) * scale)))] = 0
    return out


def stretch_images(images: DataFrame, data: str = "data", width: str = "width") -> DataFrame:
    """images (bytes of RGB rows) with `grey`, a byte for each pixel."""

    @F.pandas_udf("binary")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else stretch(np.frombuffer(b, np.uint8).reshape(-1, 3)).tobytes())

    return images.withColumn("grey", run(F.col(data)))


def mean_confidence(words: Column) -> Column:
    """Mean confidence of words, 0 where there are none."""
    total = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["confidence"])
    return F.when(F.size(words) > 0, total / F.size(words)).otherwise(F.lit(0.0))


def choose_rotation(words: Column, clockwise: Column, counter: Column) -> Column:
    """none, cw or ccw: turned readings count only for pages of more than ten words with a mean below one half."""
    now, cw, ccw = mean_confidence(words), mean_confidence(clockwise), mean_confidence(counter)
    doubtful = (now < 0.5) & (F.size(words) > 10)
    return F.when(doubtful & (cw > now) & (cw >= ccw), "cw").when(doubtful & (ccw > now), "ccw").otherwise("none")


def to_page(words: Column, rotation: Column, width: Column, height: Column, scale: int = SCALE) -> Column:
    """Word boxes of the (turned) raster as points of the page; width and height: pixels of the raster before turning."""

    def turn(w: Column) -> Column:
        def pick(cw: Column, ccw: Column, plain: Column) -> Column:
            return (F.when(rotation == "cw", cw).when(rotation == "ccw", ccw).otherwise(plain) / F.lit(float(scale))).cast("double")

        return F.struct(
            w["text"].alias("text"),
            pick(w["y0"], width - w["y1"], w["x0"]).alias("x0"),
            pick(height - w["x1"], w["x0"], w["y0"]).alias("y0"),
            pick(w["y1"], width - w["y0"], w["x1"]).alias("x1"),
            pick(height - w["x0"], w["x1"], w["y1"]).alias("y1"),
            w["confidence"].alias("confidence"),
        )

    return F.transform(words, turn)


def clean_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, clean_text): lines (line_idx, word_idx, text, confidence) whose words have a mean confidence of one half."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ")
    lines = words.groupBy(*keys, "line_idx").agg(F.trim(line).alias("line"), F.avg("confidence").alias("c")).where("c >= 0.5 and line <> ''")
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda x: x["line"]), "\n").alias("clean_text"))
