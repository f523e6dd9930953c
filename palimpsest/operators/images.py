"""Pictures as columns of bytes: tiles by arithmetic on places, gray values, resizing and icons in Arrow batches.

An image is a row (image_id, width, height, pixels): rows from top to bottom, four bytes a pixel
(red, green, blue, opacity), or one for gray images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import icon_input, resized
from .proofs import leaf

TILE, BANDS = 64, 4


def whole(bands: int = BANDS) -> Column:
    """Whether an image has as many bytes as its size says, and a size."""
    c = F.col
    return F.coalesce((c("width") > 0) & (c("height") > 0) & (F.octet_length("pixels") == c("width").cast("long") * c("height") * bands), F.lit(False))


def tiles(images: DataFrame, size: int = TILE, bands: int = BANDS) -> DataFrame:
    """(image_id, index, x, y, width, height, pixels) of each image's tiles, row by row; those at the right and lower edge are cut.

    Images that aren't whole have none. The tiles of an image are worked out in one array, its
    bytes are not repeated for each of them.
    """
    c = F.col
    across = F.ceil(c("width") / size).cast("int")
    down = F.ceil(c("height") / size).cast("int")

    def tile(i: Column) -> Column:
        x, y = (i % across) * size, F.floor(i / across).cast("int") * size
        w, h = F.least(F.lit(size), c("width") - x), F.least(F.lit(size), c("height") - y)
        rows = F.transform(F.sequence(y, y + h - 1), lambda r: F.substr("pixels", ((r * c("width") + x) * bands + 1).cast("int"), (w * bands).cast("int")))
        bytes_ = F.aggregate(rows, F.lit(b""), lambda acc, row: F.concat(acc, row))
        return F.struct(i.cast("long").alias("index"), x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("width"), h.cast("int").alias("height"), bytes_.alias("pixels"))

    found = images.filter(whole(bands)).select("image_id", F.explode(F.transform(F.sequence(F.lit(0), across * down - 1), tile)).alias("t"))
    return found.select("image_id", "t.*")


def tile_leaves(images: DataFrame, size: int = TILE, bands: int = BANDS) -> DataFrame:
    """(image_id, index, hash): the leaves of a tree over each image's tiles, for `proofs.levels`."""
    return tiles(images, size, bands).select("image_id", "index", leaf(F.col("pixels")).alias("hash"))


def _each(images: DataFrame, of: Callable[[np.ndarray], np.ndarray], bands: int) -> DataFrame:
    """(image_id, values): of(an image, height by width by bands) as doubles, row by row; null for images that aren't whole."""
    kind = dict(images.dtypes)["image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, p in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                out.append(None if p is None else of(np.frombuffer(p, np.uint8).reshape(h, w, bands)).astype(float).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["image_id", "values"])

    rows = images.select("image_id", "width", "height", F.when(whole(bands), F.col("pixels")).alias("pixels"))
    return rows.mapInArrow(run, f"image_id {kind}, values array<double>")


def gray_of(image: np.ndarray) -> np.ndarray:
    return image[..., 0].astype(float) if image.shape[2] == 1 else image[..., 0] * 0.299 + image[..., 1] * 0.587 + image[..., 2] * 0.114


def gray(images: DataFrame, bands: int = BANDS) -> DataFrame:
    """(image_id, values): each pixel's light, 0 to 255."""
    return _each(images, gray_of, bands)


def resized_to(images: DataFrame, width: int, height: int, bands: int = BANDS) -> DataFrame:
    """(image_id, values): the light of each image in another size, between pixels by distance."""
    return _each(images, lambda x: resized(gray_of(x), height, width), bands)


def icon_inputs(images: DataFrame, size: int = 20, bands: int = BANDS) -> DataFrame:
    """(image_id, values): each icon light on dark, without its frame, centred and of one size, as a classifier takes it."""
    return _each(images, lambda x: icon_input(gray_of(x) / 255, size), bands)
