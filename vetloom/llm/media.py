"""Media columns: payloads stored as progressive JPEG, and images read as full-resolution RGB.

:func:`store` puts each text's bytes, filled up with zeros to a positive
multiple of 64, into the coefficients of an image, which loses nothing.
:func:`load` reads images: it accumulates spectral-selection and
successive-approximation scans into coefficient arrays, transforms them back,
upsamples the chroma and gives the RGB tensor, the feature of its colours and,
for images that ``store`` made, the payload.  Both work on a few MB at a time
within a task and need no shuffle, so a hot source or group makes no difference.

Contract: null text counts as empty.  A null image gives nulls, and so do bytes
that are no such image, with the reason in ``error``.  All other columns are
kept; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from . import jpeg

#: Bytes of payload or of images that are handled together.
STEP_BYTES = 2 << 20


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each filled up with zeros to a positive multiple of 64 bytes; their lengths before."""
    n = np.diff(offsets)
    size = np.maximum(1, -(-n // jpeg.BLOCK)) * jpeg.BLOCK
    out = np.zeros(int(size.sum()), np.uint8)
    out[A.concat_ranges(np.cumsum(size) - size, n)] = data
    return out, n


def store(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """All columns but the text, and the image of its bytes."""
    rest = [c for c in docs.columns if c not in (text_col, out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in A.text_steps(column, STEP_BYTES):
                data, n = _padded(*A.text_buffer(column.slice(a, b - a)))
                images = pa.array(jpeg.write(data, n), pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), images], [*rest, out_col])

    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, T.StructType([*(docs.schema[c] for c in rest), T.StructField(out_col, T.BinaryType())]))


def feature(tensor: np.ndarray) -> str:
    """Size, and mean and deviation of red, green and blue."""
    flat = tensor.reshape(-1, 3).astype(np.int64)
    mean = flat.sum(axis=0) / len(flat)
    square = np.einsum("ij,ij->j", flat, flat) / len(flat)
    deviation = np.sqrt(np.maximum(0, square - mean * mean))
    return f"{tensor.shape[1]}x{tensor.shape[0]} mean " + " ".join(f"{x:.2f}" for x in mean) + " deviation " + " ".join(f"{x:.2f}" for x in deviation)


def _payload(image: jpeg.Image, coefs: np.ndarray) -> tuple[bytes | None, int | None]:
    if not image.comment.startswith(jpeg.MARK):
        return None, None
    n = int(image.comment[len(jpeg.MARK) :])
    blocks = max(1, -(-n // jpeg.BLOCK))
    return coefs[image.base[0] : image.base[0] + blocks].astype(np.uint8).tobytes(), n


def load(media: DataFrame, media_col: str = "media", tensors: bool = True) -> DataFrame:
    """All columns, then ``payload``, ``n_bytes``, ``width``, ``height``, ``feature``, ``error`` and, if asked for, ``tensor`` (height x width x 3 bytes)."""
    added = {"payload": T.BinaryType(), "n_bytes": T.LongType(), "width": T.IntegerType(), "height": T.IntegerType(), "feature": T.StringType(), "error": T.StringType()}
    if tensors:
        added["tensor"] = T.BinaryType()
    rest = [c for c in media.columns if c not in added]
    schema = T.StructType([*(media.schema[c] for c in rest), *(T.StructField(k, v) for k, v in added.items())])
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary()]

    def rows(files: list[bytes]) -> list[tuple]:
        images, coefs = jpeg.read(files)
        blocks, out = jpeg.samples(images, coefs), []
        for image in images:
            tensor = jpeg.rgb(image, blocks)
            row = (*_payload(image, coefs), image.width, image.height, feature(tensor), None)
            out.append((*row, tensor.tobytes()) if tensors else row)
        return out

    def each(files: list[bytes]) -> list[tuple]:
        """All files together, or one by one if some are no such images."""
        try:
            return rows(files)
        except Exception as error:  # whatever broken bytes lead to is a result of its own
            if len(files) > 1:
                return [row for f in files for row in each([f])]
            return [(*(None,) * 5, str(error) or type(error).__name__, *(None,) * tensors)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(rest.index(media_col))
            for a, b in A.text_steps(column, STEP_BYTES):
                files = column.slice(a, b - a).to_pylist()
                found = iter(each([f for f in files if f is not None]))
                columns = zip(*[next(found) if f is not None else (None,) * len(added) for f in files], strict=True)
                new = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *new], schema.names)

    return media.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)
