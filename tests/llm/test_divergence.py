import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from creditloom.llm import divergence
from creditloom.llm.divergence import divergence as diverge

SCHEMA = "doc_id bigint, lang string, source string, text string, term string, p int, group int"


def by_hand(rows, min_docs, top=10):
    docs = defaultdict(list)
    for lang, source, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        docs[lang or ""].append((source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)))
    out = []
    for lang, held in docs.items():
        df = Counter(t for _, terms in held for t in set(terms))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for source, terms in held:
            counts[source].update(t for t in terms if t in kept)
            counts[None].update(t for t in terms if t in kept)
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            if s is None:
                continue
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o not in (s, None)]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def rows_of(n, sources, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Stone", "rivêr", "ÄB", "moon", "x") for b in ("", "s", "é", "ing", "你", "'d", "3k")]
    rows = []
    for _ in range(n):
        source = rng.randrange(sources)
        own = [vocabulary[(source * 7 + k) % len(vocabulary)] for k in range(5)]
        words = [rng.choice(own if rng.random() < 0.4 else vocabulary[: 3 + source]) for _ in range(rng.randrange(30))]
        rows.append((rng.choice(["en", "de", None]), rng.choice([f"s{source}", "hot"]), " ".join(words)))
    return rows + [("en", None, None), ("en", "empty", ""), ("lone", "s1", "Only one source " * 12), ("xx", "a", "few"), ("xx", "b", "words"), (None, None, "### 123"), ("en", "long", "Moon stone-river " * 20_000)] + rows[:3] * 2


def frame(spark, rows):
    return spark.createDataFrame([(i, a, b, c, "t", 1, 2) for i, (a, b, c) in enumerate(rows)], SCHEMA).repartition(4)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("share", "bucket_rows", "tile"), [(0.25, 200_000, 256), (0.0, 40, 3), (1.0, 40, 3), (0.4, 15, 2)])
def test_sums_are_exact_however_terms_and_groups_are_split(spark, share, bucket_rows, tile):
    rows = rows_of(220, 7, 1)
    assert found(diverge(frame(spark, rows), min_docs=3, heavy_share=share, bucket_rows=bucket_rows, tile=tile)) == by_hand(rows, 3)


def test_heavy_and_light_tiles_equal_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(20):
        groups, terms = int(rng.integers(1, 12)), int(rng.integers(0, 30))
        p0 = rng.integers(1, 10**9, groups)
        whole = np.tile(p0, (terms, 1))
        given = rng.random((terms, groups)) < 0.3
        whole[given] = rng.integers(1, 10**9, given.sum())
        term, group = np.nonzero(given)
        heavy = (rng.random(terms) < 0.5)[term]
        half = groups // 2
        for left, right in ((np.arange(groups),) * 2, (np.arange(half), np.arange(half, groups))):
            if not len(left):
                continue
            s, t, value = divergence.tile_sums(left, right, {"group": np.arange(groups), "p": p0}, {"term": term, "group": group, "p": whole[given], "heavy": heavy}, terms)
            want = {(a, b): sum(divergence.apart(int(whole[k, a]), int(whole[k, b])) for k in range(terms)) for a in left for b in right if a < b}
            assert dict(zip(zip(s.tolist(), t.tolist(), strict=True), value.tolist(), strict=True)) == want


def test_shares_beyond_64_bits_are_whole(spark):
    row = spark.range(1).selectExpr("200000000000000000L as n", "900000000000000000L as total", "3L as terms").select(divergence._share("n", "total", "terms")).first()
    assert row[0] == 1 + 10**9 * (2 * 10**17 + 2) // (9 * 10**17 + 6)


def test_no_documents(spark):
    assert diverge(frame(spark, [])).count() == 0


def test_terms_of_whole_texts():
    raw = np.frombuffer("Ab1é ZZb\x00q".encode() + b"Ab", np.uint8)
    terms, text = divergence.cut_terms(raw, np.array([0, len(raw) - 2, len(raw) - 2, len(raw)]))
    assert terms.to_pylist() == ["ab", "é", "zzb", "q", "ab"]
    assert text.tolist() == [0, 0, 0, 0, 2]


def test_the_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(f"select lang, source, part, item, value, rank from ({divergence.OP12_SQL})").fetchall()
    assert found(divergence.op12_source_divergence(spark, "/root/testdata/sf0.01")) == sorted(want)
