import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from creditloom.llm import bytesops, langid, toxicity

PARTS = {"en": "the and ing tion re er st".split(), "de": "sch ung keit der ein ch ver".split(), "fr": "eau eux é que ment le ou".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_is_found_on_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(3, 60)), lang) for i in range(600) for lang in [rng.choice(list(PARTS))]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df.where("doc_id < 400"), "doc_id", "text", "lang")
    got = langid.predict(df.where("doc_id >= 400"), model, "doc_id", "text", F.col("lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(odd_docs, no_docs):
    model = langid.fit(odd_docs, "doc_id", "text", "lang")
    assert model[0] == ["de", "en"]
    rows = langid.predict(odd_docs, model, "doc_id", "text").collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 3)) and by[4].lang_pred in model[0]
    assert langid.predict(no_docs, model).count() == 0
    empty = langid.fit(no_docs, "doc_id", "text", "lang")
    assert {r.lang_pred for r in langid.predict(odd_docs, empty).collect()} == {"und"}


def gram_buckets(text):
    """All n-grams' buckets by the definition, in whole numbers."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    out = []
    for order in (1, 2, 3, 4):
        for i in range(len(data) - order + 1):
            h = data[i]
            for b in data[i + 1 : i + order]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
            out.append((h * (0x9E3779B1 + 2 * order) & 0xFFFFFFFF) >> 15)
    return out


def test_bayes_by_definition(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, lang, rng.randint(1, 40)), lang) for i in range(150) for lang in [rng.choice(list(PARTS))]] + [(150, "Été 你好 ABC", None), (151, None, "en"), (152, "x", "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    counts = {}
    for _, t, lang in rows:
        if t and lang:
            counts.setdefault(lang, Counter()).update(gram_buckets(t))
    names, table = model = langid.fit(df, "doc_id", "text", "lang")
    assert names == sorted(counts)
    logs = {x: (c, math.log(c.total() + langid.SMOOTH * langid.BUCKETS)) for x, c in counts.items()}
    of = lambda x, b: math.log(logs[x][0][b] + langid.SMOOTH) - logs[x][1]
    for r in langid.predict(df, model).collect():
        t = rows[r.doc_id][1]
        if t is None:
            assert (r.lang_pred, r.score, r.fit) == ("und", 0.0, 0.0)
            continue
        grams = gram_buckets(t)
        sums = {x: sum(of(x, b) for b in grams) for x in names}
        best = max(sums.values())
        share = 1 / sum(math.exp((v - best) / len(grams) * min(len(grams), langid.TEMPER)) for v in sums.values())
        assert r.lang_pred == max(sorted(sums), key=sums.get) and abs(r.score - share) < 1e-4 and abs(r.fit - best / len(grams)) < 1e-4


def test_training_runs_in_the_scans_own_tasks_and_keeps_rare_languages(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, "en", 20), "en") for i in range(3000)] + [(i, text(rng, "de", 20), "de") for i in range(3000, 3004)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(7)
    sample = langid.training_sample(df, "doc_id", "text", "lang", max_train=500)
    assert sample.rdd.getNumPartitions() >= 7
    by = Counter(r.lang for r in sample.collect())
    assert by["de"] == 4 and 400 < by["en"] < 600
    assert langid.fit(df, "doc_id", "text", "lang", max_train=500)[0] == ["de", "en"]
    many = spark.createDataFrame([(i, f"words of {i}", f"l{i:03d}") for i in range(230)], "doc_id bigint, text string, lang string")
    assert len(langid.fit(many, "doc_id", "text", "lang")[0]) == 230


def test_text_in_no_known_language_does_not_fit(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, 40), lang) for i in range(300) for lang in [rng.choice(list(PARTS))]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df, "doc_id", "text", "lang")
    junk = [(0, "你好世界" * 20), (1, "".join(rng.choice("qxzjkvw0123456789") for _ in range(200))), (2, text(rng, "fr", 30)), (3, text(rng, "de", 2))]
    fits = {r.doc_id: r.fit > langid.UNFIT for r in langid.predict(spark.createDataFrame(junk, "doc_id bigint, text string"), model).collect()}
    assert fits == {0: False, 1: False, 2: True, 3: True}


def test_grams_stay_inside_their_texts():
    data, off = bytesops.flat(pa.array(["Abc", "", "zz"]))
    for order in (1, 2, 3, 4):
        h, at = langid.grams(data, off, order)
        assert np.diff(at).tolist() == [max(0, 4 - order), 0, max(0, 3 - order)] and at[-1] == len(h)
    assert np.array_equal(langid.grams(*bytesops.flat(pa.array(["ABC"])), 2)[0], langid.grams(*bytesops.flat(pa.array(["abc"])), 2)[0])


def toxic_rows(n, seed):
    rng = random.Random(seed)
    bad = ["stupid", "moron", "idiot", "worthless"]
    rows = []
    for i in range(n):
        words = text(rng, "en", rng.randint(20, 200)).split()
        y = int(rng.random() < 0.3)
        for _ in range(rng.randint(1, 4) * y):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity_on_held_out_texts_and_misspellings(spark):
    df = spark.createDataFrame(toxic_rows(900, 3), "doc_id bigint, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where("doc_id < 600"), "doc_id", "text", "toxic")
    got = toxicity.score(df.where("doc_id >= 600"), model, "doc_id", "text", F.col("toxic")).collect()
    hits = [(r.score >= 0.7, r.toxic == 1) for r in got]
    assert np.mean([a for a, b in hits if b]) > 0.95 and np.mean([a for a, b in hits if not b]) < 0.02
    odd = spark.createDataFrame([(0, "you are a stupidd person"), (1, "what a worthlesss thing"), (2, "the ring and the sting"), (3, ""), (4, None)], "doc_id bigint, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert scores[0] > 0.7 and scores[1] > 0.7 and scores[2] < 0.3 and scores[3] == scores[4] < 0.5


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (9, None), (None, 1), (0, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd_docs, labels, "doc_id", "text", "toxic")
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels, "doc_id", "text", "toxic")).count() == 0


def test_windows_and_subwords():
    first, end, at = toxicity.windows(np.array([0, 3, 3, 11]), 6)
    assert list(zip(first.tolist(), end.tolist(), strict=True)) == [(0, 3), (3, 3), (3, 9), (4, 10), (5, 11)] and at.tolist() == [0, 1, 2, 5]
    parts, count = toxicity.subwords(*bytesops.flat(pa.array(["Abc de", "", "x"])))
    assert count.tolist() == [0, 2, 2, 3]
    assert [np.bincount(w, minlength=3).tolist() for w, _ in parts] == [[3, 2, 1], [2, 1, 0], [1, 0, 0]]


def test_toxicity_scores_by_definition(spark):
    """A trained model's scores from its bucket values, added up word by word."""
    df = spark.createDataFrame(toxic_rows(200, 5), "doc_id bigint, text string, toxic int")
    for window in (toxicity.WINDOW, None):
        table, bias, _ = model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), "doc_id", "text", "toxic", window=window)
        texts = [r.text for r in df.limit(20).collect()] + ["Stupid!", "", "One two three four five six seven eight MORON nine"]
        got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
        for r in got:
            means = []
            for word in re.findall(r"[0-9a-z\x80-\xff]+", texts[r.doc_id].lower().encode().decode("latin-1")):
                data = b" " + word.encode("latin-1") + b" "
                grams = [toxic_bucket(data[i : i + n]) for n in toxicity.ORDERS for i in range(len(data) - n + 1)]
                means.append(sum(float(table[g]) for g in grams) / max(len(grams), 1))
            width = len(means) if window is None else window
            bags = [means[i : i + width] for i in range(max(len(means) - width + 1, 1))]
            top = max(sum(b) / max(len(b), 1) for b in bags) if means else 0.0
            assert r.score == pytest.approx(1 / (1 + math.exp(-top - bias)), abs=1e-4)


def toxic_bucket(gram):
    h = gram[0]
    for b in gram[1:]:
        h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
    h = (h ^ (h >> 13)) * (0x9E3779B1 + 2 * len(gram)) & 0xFFFFFFFF
    return h >> 12


def test_no_subword_is_left_out(spark):
    """A misspelling that one training text alone holds still moves its subwords."""
    rows = toxic_rows(300, 6) + [(300, "some words around zqxjvkw and more words", 1)]
    table, _ = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    assert table[toxic_bucket(b"zqx")] != 0 and table[toxic_bucket(b"jvkw")] != 0


def test_whole_text_bags_learn(spark):
    df = spark.createDataFrame(toxic_rows(900, 3), "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id < 600"), "doc_id", "text", "toxic", window=None)
    got = toxicity.score(df.where("doc_id >= 600"), model, "doc_id", "text", F.col("toxic")).collect()
    toxic, clean = ([r.score for r in got if r.toxic == y] for y in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.8


def test_one_labelled_id_of_many_rows_trains_on_a_bounded_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, window: seen.append(len(texts)) or (np.zeros(toxicity.BUCKETS, np.float32), 0.0))
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    different = spark.range(60_000).selectExpr("cast(1 as bigint) as doc_id", "concat('text ', id) as text").repartition(8)
    sizes = []
    real = toxicity.drawn
    monkeypatch.setattr(toxicity, "drawn", lambda most, of, *names: sizes.append((most, of, len(names))) or real(most, of, *names))
    toxicity.fit(different, labels, "doc_id", "text", "toxic", max_train=500)
    rows = different.where(real(500, 60_000, F.col("doc_id").cast("string"), F.col("text"))).count()
    assert sizes == [(500, 1, 1), (500, 60_000, 2)] and 350 < rows < 650
    sizes.clear()
    toxicity.fit(different.withColumn("text", F.lit("all alike")), labels, "doc_id", "text", "toxic", max_train=500)
    assert sizes == [(500, 1, 1), (500, 1, 2)]


def test_samples_of_very_many_rows_are_not_empty(spark):
    share = spark.range(1_000_000).where(toxicity.drawn(5_000, 10**12, F.col("id"))).count()
    assert share == 0  # one in two hundred million
    assert 0 < spark.range(1_000_000).where(toxicity.drawn(5_000, 10**9, F.col("id"))).count() < 30


def test_long_texts_are_summed_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    table = rng.normal(size=(langid.BUCKETS, 20)).astype(np.float32)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    for off in ([0, 5000], [0, 0, 1700, 1702, 5000, 5000]):
        off = np.array(off)
        want = [sum((table[langid.grams(data[a:b], np.array([0, b - a]), n)[0]].astype(float).sum(0) for n in langid.ORDERS), np.zeros(20)) for a, b in zip(off[:-1], off[1:], strict=True)]
        for piece, cells in ((1 << 20, 1 << 22), (700, 20 * 97)):
            monkeypatch.setattr(langid, "PIECE", piece)
            monkeypatch.setattr(langid, "CELLS", cells)
            total, seen = langid.gram_sums(data, off, table)
            assert np.allclose(total, want, atol=1e-3) and seen.tolist() == [sum(max(b - a - n + 1, 0) for n in langid.ORDERS) for a, b in zip(off[:-1], off[1:], strict=True)]


def test_a_column_of_anything_is_no_language(spark):
    rows = spark.range(1000).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id) as lang")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(rows, "doc_id", "text", "lang")
