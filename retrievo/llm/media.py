"""Operator 6: media columns over content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, are the 8-bit grey samples of a
PNG image 576 wide.  Images are members of tar shards in the shared folder, named by the SHA-256 of
their payload; rows carry digest, shard, offset and length.

1. ``store`` streams documents into shards.  A task stores a payload once; shards have names that no
   other attempt uses, and only the rows of the attempt that succeeds refer to them, so a task that
   is run again leaves at most an unreferenced file.  The rows are written as a table.
2. One copy of each digest, the first by shard and offset, is the one to be read.
3. ``header_columns`` fills width, height, depth and size by a range read of the header alone.
4. ``features`` reads the stored bytes back, decodes them and computes what needs the samples.

Defined cases: null text is empty text (one row of 255s); repeated rows and equal texts share one
payload; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievo.llm.storage import fresh, materialize

WIDTH = 576
BLOCK = 512  # of a tar file
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = len(SIGNATURE) + 25  # signature and IHDR


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes, level: int = 3) -> bytes:
    """A grey 8-bit PNG whose rows of 576 samples are stored unfiltered."""
    height = len(samples) // WIDTH
    rows = np.zeros((height, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(height, WIDTH)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0))
    return SIGNATURE + head + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first bytes of an image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", head[16:25])


def decode(image: bytes) -> bytes:
    """The samples of an image; checks every chunk's CRC."""
    width, height, _ = read_header(image)
    at, data = len(SIGNATURE), []
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header block."""
    fields = [(name, 100), ("0000644", 8), ("0000000", 8), ("0000000", 8), (f"{size:011o}", 12), (f"{0:011o}", 12)]
    head = b"".join(x.encode().ljust(n, b"\0") for x, n in fields) + b" " * 8 + b"0" + b"\0" * 100 + b"ustar\x0000" + b"\0" * 247
    return head[:148] + f"{sum(head):06o}".encode() + b"\0 " + head[156:]


class Shards:
    """Writes members to tar files of about ``limit`` bytes each, through any file system by URI."""

    def __init__(self, folder: str, limit: int):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.limit, self.out, self.name, self.at = limit, None, "", 0

    def add(self, digest: str, image: bytes) -> tuple[str, int]:
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", buffer_size=1 << 20)
        self.out.write(tar_header(f"{digest}.png", len(image)))
        self.out.write(image)
        self.out.write(b"\0" * (-len(image) % BLOCK))
        place = (self.name, self.at + BLOCK)
        self.at += BLOCK + len(image) + -len(image) % BLOCK
        if self.at >= self.limit:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * BLOCK))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, *, shard_bytes: int = 64 << 20) -> DataFrame:
    """Writes the shards; one row per document: doc_id, n_bytes, digest, shard, offset, length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, stored = Shards(folder, shard_bytes), {}
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                samples = payload(text)
                key = hashlib.sha256(samples).digest()
                if key not in stored:
                    image = encode(samples)
                    stored[key] = (*shards.add(key.hex(), image), len(image))
                rows.append((doc, len((text or "").encode()), key.hex(), *stored[key]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    kept = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    return materialize(kept, "media-index")


def distinct_payloads(index: DataFrame) -> DataFrame:
    """One place for each digest, in the order of the shards."""
    place = F.min(F.struct("shard", "offset", "length")).alias("p")
    return index.groupBy("digest").agg(place).select("digest", "p.*")


def _ranges(folder: str, pdf: pd.DataFrame, most: int | None) -> Iterator[tuple[int, bytes]]:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    for shard, rows in pdf.groupby("shard", sort=True):
        with files.open_input_file(f"{path}/{shard}") as f:
            for i, offset, length in zip(rows.index, rows["offset"], rows["length"], strict=True):
                yield i, f.read_at(length if most is None else min(most, length), offset)


def header_columns(places: DataFrame, folder: str) -> DataFrame:
    """Adds width, height, depth and samples, reading only the first 33 bytes of each image."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = dict(_ranges(folder, pdf, HEADER))
            meta = [read_header(heads[i]) for i in pdf.index]
            yield pdf.assign(width=[m[0] for m in meta], height=[m[1] for m in meta], depth=[m[2] for m in meta])

    return places.mapInPandas(run, "digest string, shard string, offset long, length long, width int, height int, depth int")


def describe(samples: bytes) -> str:
    """Mean, deviation, entropy and difference between neighbours of the samples."""
    x = np.frombuffer(samples, dtype=np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    f = x.astype(np.float64)
    steps = np.abs(np.diff(f)).mean()
    return f"mean={f.mean():.4f};std={f.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};step={steps:.4f}"


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(places: DataFrame, folder: str) -> DataFrame:
    """What needs the samples: reads every stored image back once and decodes it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, image in _ranges(folder, pdf, None):
                samples = decode(image)
                if len(samples) != pdf.at[i, "width"] * pdf.at[i, "height"]:
                    raise ValueError("header and samples differ")
                digest = hashlib.sha256(samples).hexdigest()
                if digest != pdf.at[i, "digest"]:
                    raise ValueError("payload doesn't match its address")
                text = f"{pdf.at[i, 'width']}x{pdf.at[i, 'height']}x{pdf.at[i, 'depth']};{describe(samples)}"
                rows.append((digest, len(samples), digest, zlib.crc32(samples[-32:]), len(image), hashlib.sha256(image).hexdigest(), text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return places.mapInPandas(run, FEATURES)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length, and the metadata and features of the payload."""
    folder = fresh(docs.sparkSession, "media-shards")
    index = store(docs, folder)
    places = distinct_payloads(index).repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return index.join(features(header_columns(places, folder), folder), "digest")
