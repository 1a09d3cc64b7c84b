import random
import zlib
from collections import defaultdict

from creditloom.llm import sharding


def brute(weights, shards):
    def fits(c):
        used, filled = 1, 0
        for w in weights:
            if w > c:
                return False
            if filled + w > c:
                used, filled = used + 1, 0
            filled += w
        return used <= shards

    c = max(weights)
    while not fits(c):
        c += 1
    return c


def test_capacity_is_the_smallest(spark):
    rng = random.Random(3)
    for n, shards, top in ((1, 4, 9), (5, 16, 50), (300, 7, 40), (300, 16, 4000), (400, 3, 30)):
        rows = sorted((f"{rng.getrandbits(256):064x}", rng.randint(1, top)) for _ in range(n))
        if n == 400:
            rows[17] = (rows[17][0], 5000)  # a hot group
        cuts, capacity = sharding.cut_hashes(spark.createDataFrame(rows, "hash string, weight bigint"), shards)
        assert capacity == brute([w for _, w in rows], shards)
        sums = defaultdict(int)
        for h, w in rows:
            sums[sum(h[: len(c)] > c for c in cuts)] += w
        assert max(sums.values()) == capacity and len(cuts) < shards


def test_odd_rows(odd_docs):
    rows = sharding.shard_documents(odd_docs, 4).collect()
    docs = odd_docs.collect()
    assert len(rows) == len(docs)
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        shard_of[r.text_crc32].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in shard_of.values())


def test_no_rows(no_docs):
    assert sharding.shard_documents(no_docs).count() == 0


def test_equal_rows_are_numbered_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_SALT", 10_000)
    df = spark.range(200_000).selectExpr("cast(null as bigint) as doc_id", "cast(null as string) as text").repartition(8)
    sizes = [r["count"] for r in sharding.dealt(sharding.hashed(df, "doc_id", "text"), []).groupBy("shard", "__salt").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 10_000
    slots = sharding.shard_documents(df).groupBy("shard").agg({"slot": "max", "*": "count"}).select("max(slot)", "count(1)").collect()
    assert [tuple(r) for r in slots] == [(199_999, 200_000)]
