import random
import re

import numpy as np
import pyarrow as pa

from creditloom.llm import bytesops, neardup

from .conftest import prose


def sets_of(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(ids, texts, k, percent):
    sets, parent = sets_of(texts, k), {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def edited(rng, base, n):
    words = base.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for size, length in ((40, 120), (25, 300), (10, 60)):
        base = prose(rng, length)
        texts += [edited(rng, base, rng.randint(0, length // 12)) for _ in range(size)]
    chain = prose(rng, 200)  # a chain: each close to the next, the ends far apart
    for _ in range(12):
        texts.append(chain)
        chain = edited(rng, chain, 3)
    texts += texts[:5] + [None, "", " ", "one", "one", "One two", "one two", "a b c", "a b c d"] + [prose(rng, 80) for _ in range(30)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(5)
    for k, percent in ((3, 85), (5, 80)):
        got = {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, k, percent).collect()}
        assert got == brute(ids, texts, k, percent)


def test_rare_shingles_find_every_link_across_components(spark):
    """across() alone, with every document a component of its own, must miss no link."""
    rng = random.Random(8)
    base = prose(rng, 100)
    texts = [edited(rng, base, rng.randint(0, 6)) for _ in range(60)]
    ids = list(range(60))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    sets = neardup.whole_sets(docs, docs.select(neardup.F.col("doc_id").alias("id")), 3, "doc_id", "text")
    open_ = sets.select("id", neardup.F.size("set").cast("long").alias("n"), neardup.F.col("id").alias("component"))
    pairs = neardup.confirm(neardup.across(open_, sets, 85), sets, 85)
    want = {(a, b) for a in ids for b in range(a) if 100 * len(x := (s := sets_of(texts, 3))[a] & s[b]) >= 85 * len(s[a] | s[b]) and x}
    assert {tuple(r) for r in pairs.collect()} == want


def test_odd_rows(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.id: r for r in rows}
    assert by[None].component_id is None and by[None].kept
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[1].component_id == 1 and by[17].component_id == 17
    assert by[10].component_id == 9 and by[11].component_id == 9 and not by[10].kept and by[9].kept
    assert sum(r.id == 9 for r in rows) == 3
    assert neardup.near_duplicates(no_docs).count() == 0


def test_miss_probability():
    for t in (0.8, 0.85):
        m = neardup.halves_for(t)
        assert 1 - (1 - (1 - t**2) ** m) ** 2 <= neardup.MISS
    rng = random.Random(1)
    base = prose(rng, 150)
    data, off = bytesops.flat(pa.array([base, edited(rng, base, 3)] * 1))
    s, at = neardup.distinct_sets(data, off, 3)
    keys = neardup.half_keys(s, at, neardup.halves_for(0.85))
    assert keys.shape == (2, 16) and np.unique(keys).size > 16


def test_different_texts_under_one_id_are_one_document(spark):
    rng = random.Random(3)
    one, other = prose(rng, 100), prose(rng, 100)
    rows = [(5, one), (5, other), (7, edited(rng, one, 1)), (9, edited(rng, other, 1)), (11, prose(rng, 50))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert sorted((r.id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True)]


def test_a_frequent_shingles_list_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST_ROWS", 4)
    test_rare_shingles_find_every_link_across_components(spark)
