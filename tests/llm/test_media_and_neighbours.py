"""Operators 6 and 8 against plain Python."""

import hashlib
import io
import tarfile
import zlib

import numpy as np
import pytest

from retrievo.llm import media, neighbours, queries, storage
from tests.conftest import SF
from tests.llm.cases import frame


@pytest.mark.parametrize("table", ["cases", "documents"])
def test_media_columns(spark, table):
    df = frame(spark) if table == "cases" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = media.media_columns(df).collect()
    assert len(rows) == df.count()
    want = {}
    for r in df.collect():
        data = (r["text"] or "").encode()
        padded = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        want[hashlib.sha256(padded).hexdigest()] = (len(data), len(padded), zlib.crc32(padded[-32:]))
    forms = {}
    for r in rows:
        assert want[r["payload_sha256"]] == (r["n_bytes"], r["payload_bytes"], r["tail_crc32"])
        assert forms.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    assert set(forms) == set(want)


def test_shards_are_tar_files_that_other_tools_read(spark, tmp_path):
    index = media.store(frame(spark), f"file://{tmp_path}", shard_bytes=4096).collect()
    members = {}
    for path in tmp_path.glob("*.tar"):
        with tarfile.open(path) as tar:
            for m in tar.getmembers():
                members[m.name] = (path.name, m.offset_data, tar.extractfile(m).read())
    for r in index:
        shard, offset, image = members[f"{r['digest']}.png"]
        assert hashlib.sha256(media.decode(image)).hexdigest() == r["digest"]
        if shard == r["shard"]:
            assert (offset, len(image)) == (r["offset"], r["length"])


def test_header_only_reads(spark, tmp_path):
    samples = media.payload("é" * 1000)
    image = media.encode(samples)
    assert media.read_header(image[: media.HEADER]) == (576, len(samples) // 576, 8)
    assert media.decode(image) == samples
    with pytest.raises(ValueError):
        media.read_header(b"no image at all, but long enough to be one")
    assert io.BytesIO(image).read(8) == media.SIGNATURE


def test_empty_media(spark):
    assert media.media_columns(frame(spark, [])).count() == 0


def brute(ids, m, every, k):
    out = {}
    for i, q in zip(ids, m, strict=True):
        if i % every == 0:
            d = np.sqrt(((m - q) ** 2).sum(1))
            out[i] = sorted((x, j) for x, j in zip(d, ids, strict=True) if j != i)[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_neighbours(spark, sf):
    folder = f"/root/testdata/{sf}"
    df = storage.table(spark, folder, "embeddings").collect()
    ids, m = np.array([r["vec_id"] for r in df]), np.array([r["embedding"] for r in df], dtype=float)
    got = {}
    for r in queries.queries()["op8_neighbours"](spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = brute(ids, m, 100, 10)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, 11))
        assert [x[1:] for x in rows] == sorted(x[1:] for x in rows)
        exact = {j: x for x, j in want[q]}
        hits += sum(j in exact for _, _, j in rows)
        assert all(abs(exact[j] - s) < 1e-12 for _, s, j in rows if j in exact)
    assert hits >= 0.9 * 10 * len(want)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]),
            (100, [0.0, 3.0]), (200, [0.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, bucket int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.search(df).collect())
    far = round(10**0.5, 6)
    assert got == [(0, 1, 6, 0.0), (0, 2, 7, 0.0), (0, 3, 100, far), (100, 1, 0, far), (100, 2, 6, far), (100, 3, 7, far)]
    assert neighbours.search(df.filter("vec_id < 0")).count() == 0
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = {r["query_id"]: 0 for r in neighbours.search(copies, chunk=50).collect()}
    assert set(got) == {0, 100, 200}
    first = [r["vec_id"] for r in neighbours.search(copies, chunk=50).filter("query_id = 100").orderBy("rank").collect()]
    assert first == list(range(10))
