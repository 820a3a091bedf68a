import re
import zlib

import pytest

from fringeline.llm.sharding import shards

from .cases import empty, table


@pytest.mark.parametrize("range_rows", [5, 100_000])
def test_prefix_sums(spark, range_rows):
    df = table(spark, [("é" * (i * 7 % 40)) if i % 9 else None for i in range(300)])
    text = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    rows = shards(df, shards=7, range_rows=range_rows).collect()
    assert len(rows) == df.count()
    assert all(r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "bytes" and r.grown_shard is None for r in rows if r.doc_id is not None)
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    sizes = [sum(r["size"] for r in rows if r.shard == k) for k in range(7)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    for k in range(7):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_as_plain_prefix_sums(spark):
    rows = [(i if i % 13 else None, ("ab" * (i * 5 % 23)) if i % 7 else None) for i in range(200)] + [(5, "same")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = sorted((-1 if i is None else i, zlib.crc32((t or "").encode()), len(t or "") + 1) for i, t in rows)
    total, before, want, slots = sum(s for *_, s in items), 0, [], {}
    for i, crc, size in items:
        shard = min(4, (before + size // 2) * 5 // total)
        want.append((i, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    got = [(-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in shards(df, shards=5, range_rows=17).collect()]
    assert sorted(got) == sorted(want)


def test_more_shards_than_rows_and_equal_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 3 + [(None, None)], "doc_id long, text string")
    rows = shards(df, shards=16).collect()
    assert len(rows) == 4 and all(0 <= r.shard < 16 for r in rows)


def test_empty_table_and_plan(spark, capsys):
    assert shards(empty(spark)).collect() == []
    shards(table(spark)).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
