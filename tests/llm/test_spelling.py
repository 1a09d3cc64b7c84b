import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from creditloom.llm import spelling

DATA = "/root/testdata/sf0.001"


def by_hand(rows, min_letters=6, min_count=5, ratio=5, drop=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return group_by_hand({w: n for w, n in counts.items() if len(w) >= min_letters and n >= min_count}, ratio)


def group_by_hand(counts, ratio=5):
    masks, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            masks[w[:i], w[i + 1 :]].add(w)
    for (a, b), group in masks.items():
        if a + b in counts:
            for w in group:
                near[w].add(a + b)
                near[a + b].add(w)
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w]) or 0) for w, n in counts.items())


def found(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], "doc_id bigint, text string, word string, n int, key string").repartition(3)


def test_the_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = by_hand(rows)
    assert found(spelling.op13_spelling_variants(spark, DATA)) == want
    assert len(want) > 100


def test_odd_texts_and_dropped_letters(spark):
    rng = random.Random(2)
    words = ["stones", "stonês", "rivers", "RIVERS", "ÄPFELN", "straße", "a" * 70, "abcdef" * 30, "éééééé"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "x", "s", "é"]) for _ in range(rng.randrange(80)))) for i in range(60)]
    rows += [(None, "Nothing Nothing nothing nothing nothing"), (None, None), (7, ""), (7, "###"), rows[0], rows[0], (9, "you你tumbled÷words " * 3000), (10, "x" * 50_000)]
    for every in (199, 3, 1, None):
        counts = spelling.word_counts(docs_of(spark, rows), "doc_id", "text", drop_every=every)
        assert found(spelling.spelling_groups(counts)) == by_hand(rows, drop=every)


def test_near_words_of_few_letters_and_long_chains(spark):
    rng = random.Random(8)
    # Words of two letters share many anagrams and repeat letters across the halves.
    counts = {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 10))): rng.choice([5, 6, 30, 31, 200, 5000]) for _ in range(300)}
    # A chain of forms, each five times as frequent.
    counts |= {"q" * 6 + "r" * k: 5 ** (k + 1) for k in range(12)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert found(spelling.spelling_groups(df)) == group_by_hand(counts)


def test_no_documents(spark):
    assert spelling.spelling_groups(spelling.word_counts(docs_of(spark, []), "doc_id", "text", drop_every=199)).count() == 0


def test_crc_goes_on_from_a_state():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    sizes = np.array([0, 1, 5, 63, 64, 65, 300, 7])
    starts = rng.integers(0, 4000, len(sizes))
    state = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(sizes))], np.uint32)
    want = [zlib.crc32(f"{k}:".encode() + data[a : a + n].tobytes()) for k, (a, n) in enumerate(zip(starts, sizes, strict=True))]
    assert spelling.crc32_after(state, data, starts, sizes).tolist() == want


def test_each_near_pair_comes_once(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaaab", "abaaaa", "aaabaa", "aaaaba"]
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")).collect()]
    assert len(pairs) == len(set(pairs))
    assert ("aaaaaa", "aaaaaaa") in pairs
