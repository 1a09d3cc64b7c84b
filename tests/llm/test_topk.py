import math
import random

from creditloom.llm import topk


def brute(vectors, queries, k):
    out = []
    for i in sorted(queries):
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), j) for q in [x for n, x in vectors if n == i] for j, v in vectors if j != i))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


def run(spark, vectors, mod, **more):
    df = spark.createDataFrame([(i, [float(x) / 256 for x in v]) for i, v in vectors], "vec_id bigint, embedding array<double>")
    return sorted(map(tuple, topk.exact_top_k(topk.integer_vectors(df, "vec_id", "embedding"), topk.F.col("id") % mod == 0, **more).collect()))


def test_equals_brute_force_with_ties_and_blocks(spark):
    rng = random.Random(1)
    for dims, span in ((6, 3), (16, 40), (3, 1)):
        vectors = [(i, [rng.randint(-span, span) for _ in range(dims)]) for i in range(300)]
        want = brute(vectors, [i for i in range(300) if i % 10 == 0], 5)
        assert run(spark, vectors, 10) == want
        assert run(spark, vectors, 10, shard_rows=70, query_rows=11) == want


def test_only_negative_scores_and_one_sign(spark):
    vectors = [(i, [1 + i % 3, 2]) if i else (0, [-5, -1]) for i in range(20)]
    assert run(spark, vectors, 50) == brute(vectors, [0], 5)
    assert run(spark, [(0, [0, 0]), (1, [1, 1]), (2, [3, 0])], 50) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [0.5]), (6, []), (None, [1.0, 1.0]), (7, [-0.001, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.exact_top_k(topk.integer_vectors(df, "vec_id", "embedding"), topk.F.col("id") == 0).collect()}
    assert got == {5: 256 * 128, 6: 0, 7: math.floor(-0.256) * 256}
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.exact_top_k(topk.integer_vectors(none, "vec_id", "embedding"), topk.F.col("id") == 0).count() == 0
