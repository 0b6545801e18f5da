import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import media

from .common import documents, empty, odd_rows, passage, repeated


def test_round_trip(spark):
    got = {r["doc_id"]: r for r in media.media_features(documents(spark)).collect()}
    for i, text in odd_rows():
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.sound_file(raw)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.features(payload))
    assert got[1]["feature"] == got[2]["feature"] and got[4]["payload_bytes"] == 64


def test_repeated_and_empty(spark):
    assert media.media_features(repeated(spark)).count() == 6
    assert media.media_features(empty(spark)).count() == 0


def test_cuts_follow_content():
    one = media.sound_file(passage(1, 20000).encode())
    ends = media.cuts(one)
    assert ends[-1] == len(one) and all(b - a <= media.MOST for a, b in zip([0, *ends], ends, strict=False)) and len(ends) > 3
    assert b"".join(media._chunks(one)) == one
    moved = media._chunks(media.sound_file(b"something else first " + passage(1, 20000).encode()))
    assert len(set(moved) & set(media._chunks(one))) >= len(ends) - 3


def test_shared_chunks_are_stored_once(spark):
    long = passage(1, 20000)
    docs = documents(spark, [(1, long), (2, long), (3, "x " + long)])
    listed = media.manifests(docs)
    n = listed.select(F.explode("chunks").alias("c")).agg(F.count("*").alias("n"), F.count_distinct("c").alias("d")).first()
    store = media.chunk_store(docs)
    assert store.count() == n["d"] < n["n"]


def test_damage_is_noticed(spark):
    docs = documents(spark, [(1, passage(1, 3000))])
    listed, store = media.manifests(docs), media.chunk_store(docs)
    other = media.chunk_store(documents(spark, [(1, "other")])).select("frame").first()["frame"]
    with pytest.raises(Exception, match="does not match"):
        media.read_media(listed, store.withColumn("frame", F.lit(other))).collect()
