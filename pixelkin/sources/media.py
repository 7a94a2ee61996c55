"""Batch jobs over file contents: checksum and capture date, pixels, perceptual hash, feature vectors.

Each job reads only the files it is given, inside tasks, a bounded piece at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelkin.functions.dates import UNSET_EXIF_DATE
from pixelkin.functions.fingerprints import GRID_COLUMNS, GRID_ROWS, TINY_NORM
from pixelkin.session import materialize
from pixelkin.sources import storage
from pixelkin.sources.exif import HEAD_BYTES, raw_dates
from pixelkin.sources.tasks import in_even_tasks

# Model input side, channel means and deviations (RGB, 0..1).
INPUT_SIDE = 224
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

_PIECE = 1 << 20
Decoder = Callable[[str], "np.ndarray | None"]


def _read(path: str) -> tuple[str | None, str | None]:
    """(md5, raw capture date) of one file in a single pass; nulls when it cannot be read."""
    try:
        with storage.open_stream(path) as stream:
            head = stream.read(HEAD_BYTES)
            digest, piece = hashlib.md5(head), head
            while piece := stream.read(_PIECE):
                digest.update(piece)
    except OSError:
        return None, None
    try:
        texts = [t.strip() for t in raw_dates(head)]
    except Exception:  # A damaged header is no date.
        texts = []
    return digest.hexdigest(), next((t for t in texts if t and t != UNSET_EXIF_DATE), None)


def read_contents(files: DataFrame) -> DataFrame:
    """(path, md5, exif_raw) of ``files`` (path)."""

    def run(batches):
        for batch in batches:
            values = [_read(p) for p in batch["path"]]
            yield pd.DataFrame(
                {
                    "path": batch["path"],
                    "md5": pd.Series([v[0] for v in values], dtype=object, index=batch.index),
                    "exif_raw": pd.Series([v[1] for v in values], dtype=object, index=batch.index),
                }
            )

    return in_even_tasks(_sized(files)).select("path").mapInPandas(run, "path string, md5 string, exif_raw string")


def _sized(files: DataFrame) -> DataFrame:
    """(path, file_size) of a table of files, stored; sizes only where it has them."""
    return materialize(files.select("path", *(c for c in files.columns if c == "file_size")), "files-to-read")


# --- pixels ------------------------------------------------------------------------------------------


def area_grid(grey: np.ndarray, rows: int = GRID_ROWS, columns: int = GRID_COLUMNS) -> np.ndarray:
    """Mean brightness of ``rows`` x ``columns`` fields; fields of tiny images share pixels."""
    height, width = grey.shape
    sums = np.zeros((height + 1, width + 1))
    sums[1:, 1:] = grey.astype(np.float64).cumsum(0).cumsum(1)
    top = (np.arange(rows) * height) // rows
    bottom = np.maximum(((np.arange(rows) + 1) * height) // rows, top + 1)
    left = (np.arange(columns) * width) // columns
    right = np.maximum(((np.arange(columns) + 1) * width) // columns, left + 1)
    total = sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]
    return total / ((bottom - top)[:, None] * (right - left)[None, :])


def pixel_hash(grey: np.ndarray) -> int:
    """Signed 64-bit gradient hash of a brightness image."""
    grid = area_grid(grey)
    bits = (grid[:, :-1] < grid[:, 1:]).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def _grey(pixels: np.ndarray) -> np.ndarray:
    """Brightness of an RGB image."""
    return pixels @ np.array([0.299, 0.587, 0.114]) if pixels.ndim == 3 else pixels


def plain_path(column) -> F.Column:
    """``file:/a``, ``file:///a`` and ``/a`` name the same file."""
    return F.regexp_replace(column, "^file:/+", "/")


#: So many paths are handed to Spark's image source one by one.
LISTED_IMAGES = 5_000


def new_images(spark: SparkSession, roots: list[str], wanted: DataFrame) -> DataFrame:
    """The images of ``wanted`` (path) as ``spark_images`` has them. A bounded number is read by name, so nothing else is
    decoded; more are picked from all below the roots."""
    few = [r["path"] for r in wanted.select("path").limit(LISTED_IMAGES + 1).collect()]
    if len(few) <= LISTED_IMAGES:
        # Hidden names are left out here as they are below a root.
        shown = [p for p in few if not re.search(r"/[_.][^/]*$", p)]
        return spark_images(spark, [re.sub(r"([\\\[\]{}*?^])", r"\\\1", p) for p in shown]) if shown else _no_images(spark)
    return spark_images(spark, roots).join(wanted.select("path"), "path", "left_semi")


def _no_images(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, height int, width int, channels int, data binary")


def spark_images(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, height, width, channels, data) decoded by Spark's image source; size -1 when undecodable."""
    image = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(roots)
    # The origin is a URI, so blanks and the like come escaped; a plus sign does not.
    origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))
    return image.select(
        plain_path(origin).alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"
    )


def image_hashes(images: DataFrame) -> DataFrame:
    """(path, phash) of decoded images; null for an undecodable one."""

    def one(height, width, channels, data):
        if data is None or height <= 0 or width <= 0 or len(data) != height * width * channels:
            return None
        pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        # Spark stores blue, green, red (and alpha).
        return pixel_hash(_grey(pixels[:, :, 2::-1]) if channels >= 3 else pixels[:, :, 0])

    def run(batches):
        for batch in batches:
            values = [one(*row) for row in zip(batch["height"], batch["width"], batch["channels"], batch["data"])]
            yield pd.DataFrame({"path": batch["path"], "phash": pd.array(values, dtype="Int64")})

    return images.mapInPandas(run, "path string, phash long")


def decoded_hashes(files: DataFrame, decoder: Decoder) -> DataFrame:
    """(path, phash) with a decoder of the caller's choice (path -> RGB or grey array, or None)."""

    def one(path):
        try:
            pixels = decoder(path)
            return None if pixels is None else pixel_hash(_grey(pixels))
        except Exception:  # Undecodable, whatever the decoder says.
            return None

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "phash": pd.array([one(p) for p in batch["path"]], dtype="Int64")})

    return in_even_tasks(_sized(files)).select("path").mapInPandas(run, "path string, phash long")


# --- vectors -----------------------------------------------------------------------------------------


def _weights(source: int, target: int) -> np.ndarray:
    """Rows of triangle-filter weights from ``source`` to ``target`` samples."""
    scale = max(source / target, 1.0)
    centre = (np.arange(target) + 0.5) * source / target
    distance = np.abs((np.arange(source) + 0.5)[None, :] - centre[:, None]) / scale
    weight = np.maximum(0.0, 1.0 - distance)
    return weight / weight.sum(axis=1, keepdims=True)


def model_input(pixels: np.ndarray, side: int = INPUT_SIDE) -> np.ndarray:
    """1 x 3 x side x side input: resized, scaled to 0..1, normalized per channel."""
    rgb = np.repeat(pixels[:, :, None], 3, axis=2) if pixels.ndim == 2 else pixels[:, :, :3]
    rows, columns = _weights(rgb.shape[0], side), _weights(rgb.shape[1], side)
    resized = np.einsum("yh,hwc,xw->cyx", rows, rgb.astype(np.float64), columns, optimize=True)
    scaled = np.round(resized) / 255.0
    mean, std = np.array(CHANNEL_MEAN)[:, None, None], np.array(CHANNEL_STD)[:, None, None]
    return ((scaled - mean) / std).astype(np.float32)[None]


def unit_vector(values) -> np.ndarray | None:
    vector = np.asarray(values, np.float32).ravel()
    if not vector.size:
        return None
    norm = float(np.sqrt((vector.astype(np.float64) ** 2).sum()))
    return vector if norm < TINY_NORM else vector / np.float32(norm)


def embedder(load_model: Callable[[], Callable[[np.ndarray], np.ndarray]], decoder: Decoder):
    """An embedder for the pipelines: (file_id, path) -> (file_id, vector), null on failure.

    ``load_model`` runs once per task and returns input array -> feature array.
    """

    def run(batches):
        model = load_model()

        def one(path):
            try:
                pixels = decoder(path)
                return None if pixels is None else unit_vector(model(model_input(pixels)))
            except Exception:  # One bad file does not stop the batch.
                return None

        for batch in batches:
            yield pd.DataFrame({"file_id": batch["file_id"], "vector": [one(p) for p in batch["path"]]})

    def embed(files: DataFrame) -> DataFrame:
        kept = files.select("file_id", "path", *(c for c in files.columns if c == "file_size"))
        spread = in_even_tasks(materialize(kept, "files-to-embed")).select("file_id", "path")
        return spread.mapInPandas(run, "file_id string, vector array<float>")

    return embed


def onnx_model(model_path: str):
    """Loader of an ONNX model for :func:`embedder`; needs onnxruntime on the executors."""

    def load():
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda array: session.run(None, {name: array})[0]

    return load
