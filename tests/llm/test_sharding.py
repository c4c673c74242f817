import zlib

from tabsmith.llm.sharding import shard_positions, write_shards


def test_rows_law_and_contents(docs):
    rows = [(i, "text " * (i % 7)) for i in range(203)] + [(5, "same"), (5, "same"), (None, None), (None, "x"), (7, "")]
    got = write_shards(docs(rows).withColumnRenamed("lang", "slot"), shards=7, bucket_bytes=500).toPandas()
    assert len(got) == len(rows)
    count = got.groupby("shard").slot.agg(["count", "min", "max"])
    assert len(count) == 7 and count["count"].max() - count["count"].min() <= 1
    assert (count["min"] == 0).all() and (count["max"] == count["count"] - 1).all() and not got.duplicated(["shard", "slot"]).any()
    for r in got.itertuples():
        text = (r.text or "").encode()
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text)
    key = sorted(((None if d != d else d, t) for d, t in zip(got.doc_id, got.text)), key=str)
    assert key == sorted(((None if d is None else float(d), t) for d, t in rows), key=str)


def test_same_rows_same_places_and_mixed_order(docs):
    rows = [(i, f"t{i}") for i in range(300)]
    place = lambda parts: sorted((r.doc_id, r.shard, r.slot) for r in shard_positions(docs(rows, parts), 4, bucket_bytes=2000).collect())
    once = place(2)
    assert once == place(5)
    order = [d for d, *_ in sorted(once, key=lambda r: r[1:])]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 20
    other = sorted((r.doc_id, r.shard, r.slot) for r in shard_positions(docs(rows), 4, seed=18, bucket_bytes=2000).collect())
    assert other != once


def test_empty_table(docs):
    assert write_shards(docs([(1, "a")]).limit(0)).collect() == []
