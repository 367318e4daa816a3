"""Media columns: payloads stored as lossless WebP images and read back as pixel arrays.

Every row is independent: one narrow mapInArrow pass, no shuffle. A payload longer than one image
can hold goes to several images, one after another, so memory is bounded by one image and one text.

Defined results: a null text is the empty text (192 spaces as payload); repeated rows give repeated
results; an empty table gives an empty table; other columns of the input are not read. A null media
cell decodes to no image; bytes that are no lossless WebP raise WebPError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import webp
from quantloom.llm.common import read_table, texts

UNIT, WIDTH = 192, 64
#: Rows of one image; a longer payload takes more images.
ROWS = 8192
OUT_ROWS = 512
#: Share of runs of three pixels that have to occur again for references; pixels from which a cache pays, and how often a colour has to occur
#: on average; share of the bits that a transform has to save, beside those of its own tables.
REPEATED, CACHE_PIXELS, AGAIN, WORTH, HEAD_BITS, TRANSFORM_PIXELS = 0.15, 2048, 4, 0.05, 1024, 1024

DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string, n_images int, coding string"
)
DIGEST_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_images", pa.int32()), ("coding", pa.string()),
    ]
)


def pad(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return payload + b" " * (-len(payload) % UNIT or (0 if payload else UNIT))


def _bits(samples: np.ndarray) -> float:
    """What an ideal prefix code takes for 8-bit samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(counts.sum() / counts)).sum())


def _distinct(values: np.ndarray) -> int:
    ordered = np.sort(values)
    return int(np.count_nonzero(ordered[1:] != ordered[:-1])) + 1


def choose(pixels: np.ndarray) -> dict:
    """How to code (height, WIDTH) pixels, by what each way would save on these very pixels.

    palette: few colours. references: enough runs of three pixels occur again. cache: enough colours do, in
    an image large enough to pay for the longer code. predictor (a pixel's left or upper neighbour) and
    subtract_green: if the residuals' entropy is lower by a twentieth at least.
    """
    flat = pixels.ravel()
    n, colours = len(flat), _distinct(flat)
    if colours <= 256 and 8 * colours <= n:
        return {"palette": True}
    how: dict = {}
    runs = flat[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ flat[1:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ flat[2:].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    if _distinct(runs) < (1 - REPEATED) * len(runs):
        how["references"] = True
    if n >= CACHE_PIXELS and AGAIN * colours < n:
        how["cache_bits"] = 8 if n < 4 * CACHE_PIXELS else 10
    if n < TRANSFORM_PIXELS:
        return how  # a transform's tables would eat what it saves
    channels = pixels.view(np.uint8).reshape(*pixels.shape, 4)[..., :3]
    least = (1 - WORTH) * _bits(channels) - HEAD_BITS
    for mode, other in ((1, channels[:, :-1]), (2, channels[:-1])):
        own = channels[:, 1:] if mode == 1 else channels[1:]
        if len(own) and (found := _bits(own - other)) < least:
            least, how["predictor"] = found, mode
    if "predictor" not in how and _bits(channels[..., 1]) + _bits(channels[..., (0, 2)] - channels[..., 1:2]) < least:
        how["subtract_green"] = True
    return how


def store(payload: bytes, used: list[str] | None = None) -> bytes:
    """The payload, whose length is a multiple of 192, as one or more lossless WebP images of 64 pixels a row.

    used: gets the ways of coding of each image.
    """
    images = []
    for start in range(0, len(payload), UNIT * ROWS):
        rgb = np.frombuffer(payload[start : start + UNIT * ROWS], np.uint8).reshape(-1, 3).astype(np.uint32)
        pixels = (webp.ALPHA | rgb[:, 0] << np.uint32(16) | rgb[:, 1] << np.uint32(8) | rgb[:, 2]).reshape(-1, WIDTH)
        how = choose(pixels)
        if used is not None:
            used.append("+".join(sorted(how)) or "literals")
        if "predictor" in how:
            how["predictor"] = np.full((-(-pixels.shape[0] // 16), -(-WIDTH // 16)), how["predictor"])
        images.append(webp.encode_webp(pixels, **how))
    return b"".join(images)


def load(media: bytes) -> bytes:
    """What store() was given."""
    parts = []
    for pixels in webp.decode_all(media):
        channels = np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, 4)
        parts.append(np.ascontiguousarray(channels[:, 2::-1]).tobytes())
    return b"".join(parts)


def feature(payload: bytes) -> str:
    """Size, mean and entropy (bits) of the 8-bit samples."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    return f"{WIDTH}x{len(samples) // UNIT} mean={samples.mean():.3f} entropy={-(share * np.log2(share)).sum():.3f}"


def _chunks(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    for start in range(0, batch.num_rows, OUT_ROWS):
        yield list(zip(*(c.to_pylist() for c in batch.slice(start, OUT_ROWS).columns), strict=True))


def encode_media(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media (binary): each text's padded UTF-8 as lossless WebP."""

    def run(batches):
        for batch in batches:
            for rows in _chunks(batch):
                media = [store(pad((t or "").encode())) for _, t in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])

    return texts(frame, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


def decode_media(frame: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, image (from 0), width, height, pixels: one row per image, pixels as ARGB numbers row by row."""

    def run(batches):
        names = ["doc_id", "image", "width", "height", "pixels"]
        for batch in batches:
            for doc_id, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, pixels in enumerate(webp.decode_all(media) if media is not None else ()):
                    flat = pa.array(pixels.ravel().astype(np.int64))
                    cell = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([k], pa.int32()), pa.array([pixels.shape[1]], pa.int32()), pa.array([pixels.shape[0]], pa.int32()), cell], names)

    out = frame.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{media_col}` media")
    return out.mapInArrow(run, "doc_id long, image int, width int, height int, pixels array<long>")


def _digest(doc_id: int | None, text: str | None) -> tuple:
    own = (text or "").encode()
    used: list[str] = []
    media = store(pad(own), used)
    back = load(media)  # everything below comes from the stored bytes
    tail = zlib.crc32(back[-16:])
    images = -(-len(back) // (UNIT * ROWS))
    return doc_id, len(own), len(back), hashlib.sha256(back).hexdigest(), tail, len(media), hashlib.sha256(media).hexdigest(), feature(back), images, ",".join(sorted(set(used)))


def media_digest(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back and describes what came back."""

    def run(batches):
        for batch in batches:
            for rows in _chunks(batch):
                columns = zip(*(_digest(*row) for row in rows), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, DIGEST_ARROW, strict=True)], schema=DIGEST_ARROW)

    return texts(frame, id_col, text_col).mapInArrow(run, DIGEST)


def op4_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_media_webp": op4_media_webp}
ORACLE_SQL: dict[str, str] = {}
