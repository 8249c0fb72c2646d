"""Progressive JPEG: exact round trips, and images of the JVM's own writer and reader."""

import hashlib
import zlib

import numpy as np
import pytest

from vetloom.llm import jpeg, media, queries

SCHEMA = "doc_id long, text string, media string, feature int"


def padded(b):
    return b + bytes(-len(b) % 64 if b else 64)


def payloads():
    rng = np.random.default_rng(5)
    yield from (b"", b"a", b"hello world " * 30, bytes([1]) * 200, bytes(range(256)) * 5, (b"\0" * 20 + b"\1") * 300, b"\0" * 4000)
    for zeros in (0, 2, 20, 60):
        yield rng.choice(np.array([0] * zeros + [1, 2, 3, 200, 255], np.uint8), 3000).tobytes()


def test_payloads_round_trip():
    some = list(payloads())
    files = jpeg.write(np.frombuffer(b"".join(map(padded, some)), np.uint8), np.array([len(p) for p in some]))
    images, coefs = jpeg.read(files)
    for payload, image in zip(some, images, strict=True):
        assert media._payload(image, coefs) == (padded(payload), len(payload))
    alone = [jpeg.write(np.frombuffer(padded(p), np.uint8), np.array([len(p)]))[0] for p in some]
    assert alone == files  # a batch makes no difference
    blocks = jpeg.samples(images, coefs)
    one_image, one_coefs = jpeg.read([files[4]])
    assert (jpeg.rgb(one_image[0], jpeg.samples(one_image, one_coefs)) == jpeg.rgb(images[4], blocks)).all()


def _java_gray(spark, data):
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    raster = image.getRaster()
    h, w, bands = raster.getHeight(), raster.getWidth(), raster.getNumBands()
    return np.array([[raster.getSample(x, y, 0) if bands == 1 else [raster.getSample(x, y, i) for i in range(3)] for x in range(w)] for y in range(h)])


def _java_progressive(spark, pixels):
    """A progressive image by the JVM's writer."""
    jvm, (h, w, *color) = spark._jvm, pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1 if color else 10)
    raster = image.getRaster()
    for y in range(h):
        for x in range(w):
            for i in range(3 if color else 1):
                raster.setSample(x, y, i, int(pixels[y, x, i] if color else pixels[y, x]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.stream.MemoryCacheImageOutputStream(out))
    whole = jvm.javax.imageio.IIOImage(image, None, None)
    writer.write(None, whole, param)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("color", [False, True])
def test_reads_other_writers(spark, color):
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:21, 0:37]
    gray = np.clip(120 + 60 * np.sin(x / 5) + 40 * np.cos(y / 4) + rng.normal(0, 8, x.shape), 0, 255)
    pixels = np.stack([gray, 255 - gray, gray * 0 + 90], axis=-1) if color else gray
    data = _java_progressive(spark, pixels.astype(np.uint8))
    images, coefs = jpeg.read([data])
    assert len(images[0].script) > 4
    got = jpeg.rgb(images[0], jpeg.samples(images, coefs)).astype(int)
    want = _java_gray(spark, data).astype(int)
    if color:  # the JVM interpolates chroma, so colours differ at edges
        assert np.abs(got - want).mean() < 6
    else:
        assert np.abs(got[:, :, 0] - want).max() <= 2


def test_other_readers_read_ours(spark):
    text = b"The quick brown fox jumps over the lazy dog. " * 12
    data = jpeg.write(np.frombuffer(padded(text), np.uint8), np.array([len(text)]))[0]
    images, coefs = jpeg.read([data])
    ours = jpeg.rgb(images[0], jpeg.samples(images, coefs)).astype(int)
    theirs = _java_gray(spark, data).astype(int)
    assert theirs.shape == ours.shape and np.abs(theirs - ours).mean() < 12


def test_rows(spark):
    texts = ["", None, "plain", "ünïcode \u0000\u0001 " * 90, "plain"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, "again", "clash", 2)]
    got = media.load(media.store(spark.createDataFrame(rows, SCHEMA)), tensors=True)
    assert got.columns == ["doc_id", "media", "payload", "n_bytes", "width", "height", "feature", "error", "tensor"]
    found = got.collect()
    assert sorted((r.doc_id, bytes(r.payload), r.n_bytes) for r in found) == sorted((i, padded((t or "").encode()), len((t or "").encode())) for i, t, *_ in rows)
    assert all(len(r.tensor) == 3 * r.width * r.height for r in found)
    same = [r for r in found if bytes(r.payload) == padded(b"plain")]
    assert len({(bytes(r.media), r.feature) for r in same}) == 1
    assert media.load(media.store(spark.createDataFrame([], SCHEMA))).count() == 0
    nulls = media.load(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()
    assert nulls.payload is None and nulls.tensor is None and nulls.error is None


def test_broken_images_are_rows_of_their_own(spark):
    good = jpeg.write(np.frombuffer(padded(b"fine"), np.uint8), np.array([4]))[0]
    files = [good, b"", b"no image", good[: len(good) // 2], bytes([255, 216, 255, 217]), good]
    got = {r.i: r for r in media.load(spark.createDataFrame(list(enumerate(files)), "i long, media binary").coalesce(1)).collect()}
    assert len(got) == len(files)
    for i in (0, 5):
        assert bytes(got[i].payload) == padded(b"fine") and got[i].error is None and got[i].tensor is not None
    for i in (1, 2, 3, 4):
        assert got[i].error and got[i].payload is None and got[i].tensor is None


def test_query(spark, small_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for r in queries.op2_media(spark, small_dir).collect():
        payload = padded(texts[r.doc_id])
        assert len(r.tensor) == 3 * r.width * r.height
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_a_very_long_text():
    """Several rounds of lanes, in writing and reading."""
    text = b"a long text, all in one image. \x00\x01" * 140_000
    files = jpeg.write(np.frombuffer(padded(text) + padded(b"short"), np.uint8), np.array([len(text), 5]))
    images, coefs = jpeg.read(files)
    assert [media._payload(i, coefs)[0] for i in images] == [padded(text), padded(b"short")]
    assert jpeg.rgb(images[0], jpeg.samples(images, coefs)).shape == (images[0].height, images[0].width, 3)
