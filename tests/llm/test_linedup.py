import random
import re
import time

import numpy as np

from creditloom.llm import linedup


def brute(rows, min_words):
    """rows in order; deletes every line in a run of min_words words that also starts earlier."""
    seen, out = set(), []
    for text in rows:
        if text is None:
            out.append((None, 0))
            continue
        lines = text.split("\n")
        words, gone = [len(x.split()) for x in lines], set()
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += words[b]
                if n >= min_words:
                    run = "\n".join(lines[a : b + 1])
                    if run in seen:
                        gone.update(range(a, b + 1))
                    seen.add(run)
        out.append(("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 1, 2, 3, 8]))) for _ in range(12)]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.8 else f"only {rng.random()}" for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += [texts[3] + "\n" + texts[7], pool[0] + "\n" + "\n".join([pool[5]] * 9), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for least in (3, 6, 11):
        got = {r.doc_id: (r.text, r.dropped_lines) for r in linedup.drop_repeated_lines(df, min_words=least).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, least)


def test_odd_rows(odd_docs, no_docs):
    rows = linedup.drop_repeated_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count() and "hash" in rows[0].asDict()
    by = {r.doc_id: r for r in rows}
    assert by[0].text is None and by[1].text == "" and by[2].text == " \n\t "
    assert by[12].dropped_lines == 0 and by[13].text == "other\nlast\n" and by[14].text == "" and by[10].text == ""
    assert by[9].text and by[15].text == "a\n\nb\n\n"
    assert linedup.drop_repeated_lines(no_docs).count() == 0


def test_ranks_are_places_in_the_suffix_array(spark):
    lines = "a b a b a c a b".split()
    df = spark.createDataFrame([(0, i, ord(x), 0, 1) for i, x in enumerate(lines)], "row int, line int, a int, b int, words int")
    first = linedup._ranked(df, ["a", "b"], "rank")
    tables = linedup.suffix_ranks(first, 3)
    for k, table in enumerate(tables):
        got = {r.line: r.rank for r in table.collect()}
        prefix = {i: lines[i : i + (1 << k)] for i in range(len(lines)) if i + (1 << k) <= len(lines)}
        again = {i for i, p in prefix.items() if list(prefix.values()).count(p) > 1}
        assert set(got) == again
        order = sorted(again, key=lambda i: prefix[i])
        assert [got[i] for i in order] == sorted(got.values())
        assert all((got[i] == got[j]) == (prefix[i] == prefix[j]) for i in again for j in again)


def brute_words(rows, n):
    """Numbers of the words that lie in a window of n words that also starts earlier, for texts in order."""
    seen, out = set(), []
    for text in rows:
        words, gone = text.split(), set()
        for a in range(len(words) - n + 1):
            window = tuple(words[a : a + n])
            if window in seen:
                gone.update(range(a, a + n))
            seen.add(window)
        out.append([w for k, w in enumerate(words) if k not in gone])
    return out


def without_by_hand(text, gone, starts, n):
    lost, left, dropped, word = {k for a in starts for k in range(a, a + n)}, [], 0, 0
    for k, line in enumerate(text.split("\n")):
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        kept = [i for i in range(len(spans)) if word + i not in lost]
        word += len(spans)
        if k in gone or (spans and not kept):
            dropped += 1
            continue
        if len(kept) < len(spans):
            parts = [line[spans[i][0] : spans[i + 1][0]] for i in kept if i + 1 < len(spans) and i != kept[-1]]
            line = line[: spans[0][0]] + "".join(parts) + line[spans[kept[-1]][0] : spans[kept[-1]][1]] + line[spans[-1][1] :]
        left.append(line)
    return "\n".join(left), dropped


def test_texts_without_lines_and_windows_equal_the_definition():
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bé", "你", " ", "  ", "\t", "\n", "\n\n", "\r"]) for _ in range(rng.randrange(40)))
        lines, n = text.count("\n") + 1, rng.randrange(1, 5)
        starts = sorted({rng.randrange(m - n + 1) for _ in range(3)}) if (m := len(re.findall(r"[^\x20\x09-\x0D]+", text))) >= n and rng.random() < 0.7 else []
        gone = sorted({rng.randrange(lines) for _ in range(rng.randrange(4))})
        got, dropped = linedup.without(text.encode(), np.array(gone, np.int64), np.array(starts, np.int64), n)
        assert (got.decode(), dropped) == without_by_hand(text, gone, starts, n), (text, gone, starts, n)


def brute_inline(rows, n):
    """Texts in order, without lines of runs of n words and words of windows of n words that also start earlier."""
    lines, seen, out = set(), set(), []
    for text in rows:
        if text is None:
            out.append(None)
            continue
        parts, gone, starts = text.split("\n"), set(), []
        sizes, words = [len(x.split()) for x in parts], text.split()
        for a in range(len(parts)):
            for b in range(a, len(parts)):
                if sum(sizes[a : b + 1]) >= n:
                    run = "\n".join(parts[a : b + 1])
                    if run in lines:
                        gone.update(range(a, b + 1))
                    lines.add(run)
        for a in range(len(words) - n + 1):
            window = tuple(words[a : a + n])
            if window in seen:
                starts.append(a)
            seen.add(window)
        out.append(without_by_hand(text, gone, starts, n)[0] if gone or starts else text)
    return out


def test_passages_inside_lines_go(spark, monkeypatch):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(55))
    first, second = f"before it | {passage} and after\nnext line", f"Quite another text {passage} goes on. \n{passage}\n last"
    df = spark.createDataFrame([(0, first), (1, second), (2, None), (None, "alone"), (1, second)], "doc_id bigint, text string")
    got = {(r.doc_id, r.text, r.dropped_lines) for r in linedup.drop_repeated_lines(df, inline_words=50).collect()}
    assert got == {(0, first, 0), (1, "Quite another text goes on. \n last", 1), (2, None, 0), (None, "alone", 0)}

    texts = ["".join(f"w{rng.randrange(3)}{rng.choice([' ', '  ', chr(10)])}" for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for n, most in ((5, 0), (8, 1000)):  # with a filter that lets nearly all texts through, and with copies in the search; and without
        monkeypatch.setattr(linedup, "BROADCAST_KEYS", most)
        monkeypatch.setattr(linedup.joins, "BLOCK_BITS", 32_768 if most else 8)
        monkeypatch.setattr(linedup.joins, "MAX_BLOCKS", 1 << 14 if most else 1)
        monkeypatch.setattr(linedup, "HOT", 3 if most else 256)
        got = {r.doc_id: r.text.split() for r in linedup.drop_repeated_lines(df, min_words=10_000, inline_words=n).collect()}
        assert [got[i] for i in range(len(texts))] == brute_words(texts, n)
    texts += [texts[5], texts[20], f"{texts[5]} more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.text.split() for r in linedup.drop_repeated_lines(df, min_words=5, inline_words=5).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, 5)


def test_a_document_of_many_repeated_lines_takes_no_quadratic_time(spark):
    """Every line occurs twice in it; frames that are computed anew for each row would take hours."""
    half = [f"line number {i}" for i in range(100_000)]
    df = spark.createDataFrame([(0, "\n".join(half + half))], "doc_id bigint, text string")
    repeated = linedup._ranked(linedup.line_table(df.select(linedup.F.struct(linedup.F.col("doc_id").alias("id"), linedup.F.lit(0).cast("bigint").alias("text")).alias("row"), "text")), ["a", "b"], "rank").select("row", "line", "words", "rank")
    began = time.perf_counter()
    runs = linedup.shortest_runs(repeated, 50)
    assert runs.count() >= 199_000 and time.perf_counter() - began < 60
    for more in ({}, {"inline_words": 50}):
        began = time.perf_counter()
        row = linedup.drop_repeated_lines(df, **more).first()
        assert row.text == "\n".join(half) and row.dropped_lines == 100_000 and time.perf_counter() - began < 60
    # 17 lines of 3 words have 50 words or more.
    assert {r.m for r in runs.select("m").distinct().collect()} == {17}


def test_windows_of_a_very_frequent_anchor_are_dealt_over_more_salts(spark, monkeypatch):
    """One passage in every text, each time after other words, so that it is one anchor in all of them."""
    monkeypatch.setattr(linedup, "HOT", 20)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"own{i} {passage} end{i}" for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: r.text for r in linedup.drop_repeated_lines(df, inline_words=50).collect()}
    assert got == {i: t if i == 0 else f"own{i} end{i}" for i, t in enumerate(texts)}
    data = np.frombuffer("".join(texts[:300]).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts[:300]])))
    _, anchors, _ = linedup._text_anchors(data, off, 50)
    hits = np.unique(anchors).view(np.uint64)
    salts = linedup._repeated_windows(data, off, hits, np.arange(1, len(hits) + 1), 50)[3]
    assert set(salts.tolist()) <= set(range(1, len(hits) + 1)) and len(salts)


def test_copies_and_short_stretches_are_not_doubled_and_texts_are_read_four_times(spark, monkeypatch):
    """Later copies of whole texts, and repeated lines with fewer words about them than a run has, take no part in the rounds."""
    doubled, ranks = [], linedup.suffix_ranks
    monkeypatch.setattr(linedup, "suffix_ranks", lambda first, rounds: doubled.append((first.count(), rounds)) or ranks(first, rounds))
    copied = "\n".join(f"copied line {i}" for i in range(40))
    common = "\n".join(f"common line {i}" for i in range(10))
    passage = "\n".join(f"passage line {i}" for i in range(20))
    texts = [f"{word}\n{common}\n{word} too" for word in "abcdef"] + [copied] * 4 + [f"before\n{passage}\nafter", f"other\n{passage}\nlast", "a word\n" * 9, "a word\n" * 9]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).mapInArrow(counted, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.dropped_lines) for r in linedup.drop_repeated_lines(df, inline_words=50).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 50)
    assert got[9] == ("", 40) and got[11] == ("other\nlast", 20) and doubled == [(40, 5)]
    assert read.value == 4 * len(texts)


def test_texts_in_several_pieces_and_copies_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(6)}" for _ in range(rng.choice([0, 1, 2, 5]))) for _ in range(9)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(40)]
    texts += [texts[k] for k in (0, 3, 3, 9, 12)] + [pool[0], pool[0], "one two three four", "one two three four", None, None]
    monkeypatch.setattr(linedup, "PIECE", 3, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for most in (0, 1000):
        monkeypatch.setattr(linedup, "BROADCAST_KEYS", most)
        got = {r.doc_id: (r.text, r.dropped_lines) for r in linedup.drop_repeated_lines(df, min_words=6).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 6)
        got = {r.doc_id: r.text for r in linedup.drop_repeated_lines(df, min_words=4, inline_words=4).collect()}
        assert [got[i] for i in range(len(texts))] == brute_inline(texts, 4)
        # Copies that are too short for a run of lines lose their windows.
        got = {r.doc_id: None if r.text is None else r.text.split() for r in linedup.drop_repeated_lines(df, min_words=30, inline_words=3).collect()}
        known = [i for i, t in enumerate(texts) if t is not None]
        assert [got[i] for i in known] == brute_words([texts[i] for i in known], 3)


def test_runs_are_told_over_batches_of_any_size():
    """A text's lines come together though batches part them; other texts, equal hashes and repeated rows do not mix."""
    rng = random.Random(9)
    rows = [(rng.randrange(3), rng.choice([None, "x", "y"]), line) for line in range(30) for _ in range(4)]
    rows.sort(key=lambda r: (r[0], r[1] or "", r[2]))
    for size in (1, 2, 7, len(rows)):
        batches = [linedup.pa.RecordBatch.from_pylist([{"row": {"id": i, "text": t}, "line": k} for t, i, k in rows[at : at + size]], linedup.pa.schema([("row", linedup.pa.struct([("id", linedup.pa.string()), ("text", linedup.pa.int64())])), ("line", linedup.pa.int32())])) for at in range(0, len(rows), size)]
        got = [([(r["row"]["text"], r["row"]["id"], r["line"]) for r in batch.to_pylist()], new.tolist()) for batch, new in linedup._whole_rows(iter(batches))]
        assert [r for part, _ in got for r in part] == rows
        for part, new in got:
            assert new == [k == 0 or part[k][:2] != part[k - 1][:2] for k in range(len(part))]
        begins = [part[0][:2] for part, _ in got]
        assert len(set(begins)) == len(begins)
