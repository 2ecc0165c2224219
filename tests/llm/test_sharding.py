import zlib
from collections import Counter

from quern.llm.sharding import interleave

from .fixtures import SCHEMA, documents, frame, odd


def test_shards_match_the_mixture(spark):
    rows = documents()
    got = interleave(odd(frame(spark, rows)), 4).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    for source, n in Counter(r[3] for r in rows).items():
        for s in sizes:
            assert abs(sum(r["source"] == source and r["shard"] == s for r in got) - n / 4) <= 1.5
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]])) for r in got)


def test_the_same_whatever_the_partitions(spark):
    rows = documents()
    a, b = (sorted(map(tuple, interleave(spark.createDataFrame(rows, SCHEMA).repartition(n), 3).collect())) for n in (1, 7))
    assert a == b


def test_edges(spark):
    assert interleave(spark.createDataFrame([], SCHEMA), 16).count() == 0
    got = interleave(spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "a", "en", "x", 1)] * 2, SCHEMA), 16).collect()
    assert len(got) == 5
    assert all(r["slot"] == 0 for r in got)
    assert len({r["shard"] for r in got}) == 5
