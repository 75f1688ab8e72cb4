import hashlib
import zlib

import pytest

from siftwork.llm import media
from siftwork.llm.media import decode_png, encode_png, read_archive, text_media, write_archive

TEXTS = ["", None, "a", "é" * 100, "x" * 64, "y\x00\x00", "same", "same", "long " * 30_000]


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "no id")], "doc_id long, text string").selectExpr("*", "'x' as media", "1 as error")
    got = {r.doc_id: r for r in text_media(df).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.error is None
        assert r.media_bytes == len(encode_png(raw)) and r.media_sha256 == hashlib.sha256(encode_png(raw)).hexdigest()
    assert got[6][1:] == got[7][1:]
    assert text_media(df.limit(0)).count() == 0


def test_small_ranges_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(i, bytes([i % 251]) * (i * 7)) for i in range(200)], "id long, data binary").repartition(3)
    url = write_archive(df, "id", "data", f"file://{tmp_path}/arc")
    got = {r.media_id: r for r in read_archive(spark, url, range_bytes=500).collect()}
    assert len(got) == 200
    assert all(decode_png(bytes(r.media))[: r.holds] == bytes([i % 251]) * (i * 7) for i, r in got.items())
    bad = got[77]
    with open(f"{tmp_path}/arc/files/{bad.file}", "r+b") as f:
        f.seek(bad.offset + 20)
        f.write(b"\xff\xfe\xfd")
    again = {r.media_id: r for r in read_archive(spark, url).collect()}
    assert again[77].media is None and "differ" in again[77].error
    assert all(again[i].media == got[i].media for i in got if i != 77)


def test_other_pictures_are_refused():
    for data in (b"", b"GIF", encode_png(b"x")[:-3], encode_png(b"x").replace(b"IDAT", b"IDAX")):
        with pytest.raises((ValueError, Exception)):
            decode_png(data)
    assert media.padded(b"") == bytes(64)
