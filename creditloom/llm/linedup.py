"""Repeated runs of lines, found with a suffix array over line ids, and deleted where they are later copies.

Lines become ids (two 64-bit hashes of the whole line), and the corpus one sequence of ids, documents parted by ends
that equal nothing. A position whose line occurs once is settled at once. The others are sorted by prefix doubling:
ranks by 1, 2, 4, ... lines, each round sorting pairs of ranks over the cluster and settling the suffixes that have
become unique. Suffixes of equal rank in the round of w lines are an interval of the suffix array whose longest common
prefix is w lines or more, and its first member by position is the first copy.

A line is deleted when it lies in a run of whole lines of MIN_WORDS words or more that also starts at an earlier
position. Any such run is the union of shortest ones, from each of its lines forwards and backwards, so only these are
looked up: a run of m lines by the two ranks, of the largest round w <= m, at its start and w lines before its end.

Lines end at newlines, which go with a deleted line. White space around a line counts. Null texts stay null and texts
without a deleted line stay as they are, empty ones too; a text whose every line is deleted becomes empty. Documents
come in the order of their ids (nulls first), repeated ids in the order of the text's hash; equal rows share their
deletions. All columns are returned; an input's own columns lines and dropped_lines give way to the result's.

Passages inside lines are found by words (inline_words). Any run of that many words is a union of windows of exactly so
many, so a word goes when it lies in a window that also starts earlier, whatever white space parts the words. Each
window is represented by the run of a quarter of its words with the smallest hash, its anchor. Equal windows have equal
anchors, so only windows whose anchor is also in another text, or again in their own, are compared, by 64-bit hashes of
the anchor and of the window. Of a line, only its deleted words go; a line whose every word goes counts as a dropped line.

Lines and anchors come from one pass over the texts. Of equal texts the first alone is looked through: all runs of the
others are in it. A later copy of MIN_WORDS words or more loses all its lines, a shorter one its windows.
Repeated lines in a stretch of fewer than MIN_WORDS words are in no run; they are left out before the doubling.

Texts are shuffled only where they hold a repeated anchor or lose something, which a Bloom filter of at most 64 MB tells
before the shuffle. It never misses one; beyond 30 million such texts it lets more and more of the others through, which
then find nothing. Which texts have copies is broadcast up to BROADCAST_KEYS of them; beyond that a shuffle tells it.
Very long texts are one row each: their lines and windows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.operators import joins

from .bytesops import _GOLD, _powers, _R, _R_INV, cut_lineage, hashes, mix, prefix_sums, slices, span_hashes, tidy, U64, words

#: An anchor in more than HOT texts is dealt over as many salts as give each about HOT.
MIN_WORDS, HOT, BROADCAST_KEYS, PIECE = 50, 1024, 3_000_000, 4096


def cut_texts(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Rows (row, first, lines, anchors, count, size) of rows (row, text), from one pass over the texts.

    lines: two hashes of each line and its words; anchors: with n, the distinct ones of the text's windows of n words, and at
    how many places each is. Both have at most PIECE entries a row, a longer text has several rows. first: the number of the
    row's first line; count and size: the text's lines and words.
    """
    kind = rows.schema["row"].dataType.simpleString()

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches, "text"):
            breaks = np.flatnonzero(data == 10)
            text = np.searchsorted(off, breaks, side="right") - 1  # a text has a line more than it has breaks
            many = np.bincount(text, minlength=part.num_rows) + 1
            at = np.cumsum(many) - many
            starts, ends = np.empty(many.sum(), np.int64), np.empty(many.sum(), np.int64)
            starts[at], ends[at + many - 1] = off[:-1], off[1:]
            inner = np.arange(len(breaks)) + text
            starts[inner + 1], ends[inner] = breaks + 1, breaks
            word, last, of = words(data, off)
            count = np.searchsorted(word, ends) - np.searchsorted(word, starts)
            sums = prefix_sums(data)
            a, b = span_hashes(sums, starts, ends), hashes(data, starts, ends, seed=1)
            text, anchor, places = _distinct_anchors(span_hashes(sums, word, last), of, n) if n else _distinct_anchors(np.zeros(0, U64), of, 2)
            held = np.bincount(text, minlength=part.num_rows)
            pieces = np.maximum(1, -(-np.maximum(many, held) // PIECE))
            owner = np.repeat(np.arange(part.num_rows), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)

            def lists(size: np.ndarray, **fields: np.ndarray) -> pa.ListArray:
                begins = (np.cumsum(size) - size)[owner] + np.minimum(piece * PIECE, size[owner])
                return pa.ListArray.from_arrays(pa.array(np.append(begins, size.sum()).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields)))

            lines = lists(many, a=a.view(np.int64), b=b.view(np.int64), words=count.astype(np.int32))
            anchors = lists(held, a=anchor, many=places)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), pa.array((piece * PIECE).astype(np.int32)), lines, anchors, pa.array(many[owner].astype(np.int32)), pa.array(np.diff(of)[owner])], ["row", "first", "lines", "anchors", "count", "size"]
            )

    return rows.where(F.col("text").isNotNull()).select("row", "text").mapInArrow(cut, f"row {kind}, first int, lines array<struct<a: bigint, b: bigint, words: int>>, anchors array<struct<a: bigint, many: int>>, count int, size bigint")


def _lines(texts: DataFrame) -> DataFrame:
    """Rows (row, line, a, b, words), one for each line."""
    return texts.select("row", "first", F.posexplode("lines").alias("pos", "x")).select("row", (F.col("first") + F.col("pos")).alias("line"), "x.a", "x.b", "x.words")


def line_table(rows: DataFrame) -> DataFrame:
    """Rows (row, line, a, b, words): one for each line of rows (row, text), with two hashes of the line and its words."""
    return _lines(cut_texts(rows))


def first_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of cut_texts() of the first of equal texts, and those of the others."""
    equal = texts.where("first = 0").groupBy(F.col("row.text").alias("__t")).agg(F.min("row").alias("row"), F.count("*").alias("n"))
    several = cut_lineage(equal.where("n > 1").select("__t", F.xxhash64("row").alias("__first")))
    few = several.count() <= BROADCAST_KEYS
    met = texts.join(F.broadcast(several) if few else several, F.col("row.text") == F.col("__t"), "left")
    met = met.withColumn("__copy", F.col("__t").isNotNull() & (F.xxhash64("row") != F.col("__first"))).drop("__t", "__first")
    if not few:  # else a join without a shuffle, cheaper than a copy
        met = cut_lineage(met)
    return met.where("not __copy").drop("__copy"), met.where("__copy").drop("__copy")


def _ranked(pairs: DataFrame, by: list[str], into: str) -> DataFrame:
    """The pairs that occur again, with the place of their class in sorted order.

    A class of any size is one row when the classes are sorted over range partitions.
    """
    sizes = pairs.groupBy(*by).agg(F.count("*").alias("__size")).where(F.col("__size") > 1)
    spread = cut_lineage(sizes.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range partition.
    before = spread.groupBy("__part").agg(F.sum("__size").alias("__n"))
    before = before.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranks = spread.join(F.broadcast(before), "__part").withColumn(into, F.col("__before") + F.coalesce(F.sum("__size").over(inside), F.lit(0)) + 1)
    return pairs.join(ranks.select(*by, into), by)


def suffix_ranks(first: DataFrame, rounds: int) -> list[DataFrame]:
    """Tables (row, line, rank) for w = 1, 2, 4, ..., of the positions whose w-line prefix occurs again. first: the table of w = 1."""
    tables = [first.select("row", "line", "rank")]
    for k in range(rounds - 1):
        now = tables[-1]
        # A position without a repeated prefix w lines further on has no repeated prefix of 2 w lines.
        ahead = now.select("row", (F.col("line") - (1 << k)).cast("int").alias("line"), F.col("rank").alias("next"))
        wider = _ranked(now.join(ahead, ["row", "line"]), ["rank", "next"], "wider")
        tables.append(cut_lineage(wider.select("row", "line", F.col("wider").alias("rank"))))
    return tables


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches' rows, sorted by row (id, text's hash), dealt so that all of a text come together; and which begin a text."""
    kept: list[pa.RecordBatch] = []
    news: list[np.ndarray] = []

    def all_kept() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        if kept:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0], np.concatenate(news)

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        row = batch.column(0)
        ids = row.field(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        text = row.field(1).to_numpy(zero_copy_only=False)
        new = np.concatenate(([row[0].as_py() != before], (ids[1:] != ids[:-1]) | (text[1:] != text[:-1])))
        before = row[-1].as_py()
        begins = np.flatnonzero(new)
        if len(begins):
            if begins[-1]:
                kept.append(batch.slice(0, begins[-1]))
                news.append(new[: begins[-1]])
            yield from all_kept()
            kept, news = [batch.slice(begins[-1])], [new[begins[-1] :]]
        else:
            kept.append(batch)
            news.append(new)
    yield from all_kept()


def measured(repeated: DataFrame, min_words: int) -> DataFrame:
    """Rows (row, line, rank, ahead, back) of the repeated lines (row, line, words, rank) that lie in a stretch of min_words words or more.

    ahead: the lines of the shortest run of min_words words from the line on, back: of the one up to it, 0 where there is none;
    back is 0, too, where the run's first line tells it. A line in a shorter stretch is in no run, at any place.
    """
    kind, rank = (repeated.schema[c].dataType.simpleString() for c in ("row", "rank"))

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, new in _whole_rows(batches):
            line = batch.column(1).to_numpy()
            own = np.flatnonzero(new | np.concatenate(([True], line[1:] != line[:-1])))  # equal rows' lines are one
            new, line, count = new[own], line[own], batch.column(2).to_numpy()[own].astype(np.int64)
            stretch = np.cumsum(new | np.concatenate(([True], line[1:] != line[:-1] + 1))) - 1
            upto, here = np.cumsum(count), np.arange(len(line))
            start = upto - count
            end = np.minimum(np.searchsorted(upto, start + min_words), len(line) - 1)
            ahead = np.where((stretch[end] == stretch) & (upto[end] - start >= min_words), end - here + 1, 0)
            begin = np.maximum(np.searchsorted(start, upto - min_words, side="right") - 1, 0)
            back = np.where((stretch[begin] == stretch) & (upto - start[begin] >= min_words), here - begin + 1, 0)
            back[ahead[begin] == back] = 0
            give = np.flatnonzero(np.bincount(stretch, count)[stretch] >= min_words)
            at = pa.array(own[give])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(ahead[give].astype(np.int32)), pa.array(back[give].astype(np.int32))], ["row", "line", "rank", "ahead", "back"])

    together = repeated.select("row", "line", "words", "rank").repartition("row").sortWithinPartitions("row.text", "row.id", "line")
    return together.mapInArrow(measure, f"row {kind}, line int, rank {rank}, ahead int, back int")


def _each_run(lines: DataFrame) -> DataFrame:
    runs = F.array(F.struct("line", F.col("ahead").alias("m")), F.struct((F.col("line") - F.col("back") + 1).alias("line"), F.col("back").alias("m")))
    return lines.select("row", F.explode(runs).alias("run")).select("row", "run.line", "run.m").where("m > 0")


def shortest_runs(repeated: DataFrame, min_words: int) -> DataFrame:
    """Rows (row, line, m): runs of m repeated lines of min_words words or more, the shortest from each line on and up to each line."""
    return _each_run(measured(repeated, min_words))


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (row, line) of the lines that belong to a later copy of a run of at least min_words words."""
    repeated = cut_lineage(measured(_ranked(lines, ["a", "b"], "rank"), min_words))
    runs = _each_run(repeated)
    longest = runs.agg(F.max("m")).first()[0] or 0
    found = None
    for k, ranks in enumerate(suffix_ranks(repeated, longest.bit_length())):
        own = runs.where((F.col("m") >= 1 << k) & (F.col("m") < 2 << k)).withColumn("tail", (F.col("line") + F.col("m") - (1 << k)).cast("int"))
        own = own.join(ranks.withColumnRenamed("rank", "r1"), ["row", "line"]).join(ranks.select("row", F.col("line").alias("tail"), F.col("rank").alias("r2")), ["row", "tail"])
        own = own.select("row", "line", "m", "r1", "r2", F.lit(k).alias("k"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return lines.select("row", "line").limit(0)
    found = cut_lineage(found)
    key = ["k", "m", "r1", "r2"]
    first = found.groupBy(*key).agg(F.min(F.struct("row", "line")).alias("src"), F.count("*").alias("n")).where("n > 1").drop("n")
    # A run may start in a third of all rows. Joined by a hash, both sides come from exchanges of their own, and adaptive execution splits such a run's rows.
    first = first.select(F.xxhash64(*key).alias("__h"), *[F.col(c).alias(f"__{c}") for c in key], "src")
    same = [F.col(c) == F.col(f"__{c}") for c in key]
    later = found.withColumn("__h", F.xxhash64(*key)).join(first, "__h").where(same[0] & same[1] & same[2] & same[3] & (F.struct("row", "line") != F.col("src")))
    return later.select("row", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("m") - 1)).alias("line")).distinct()


def _sliding(best: np.ufunc, x: np.ndarray, m: int) -> np.ndarray:
    """The best of each m neighbours, in log m passes."""
    width = 1
    while width < m:
        step = min(width, m - width)
        x = best(x[:-step], x[step:])
        width += step
    return x


def _runs(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbours."""
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(values * _powers(_R, len(values)), dtype=U64)))
    return mix((sums[k:] - sums[:-k]) * _powers(_R_INV, len(values))[: len(values) - k + 1])


def _anchors(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows of n words inside one text, their anchors' hashes, and the hash of each run that may be an anchor."""
    part = _runs(h, max(1, n // 4))
    first = np.flatnonzero(owner[: len(h) - n + 1] == owner[n - 1 :])
    return first, _sliding(np.minimum, part, n - max(1, n // 4) + 1)[first], part


def _distinct_anchors(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct anchors (text, hash), and at how many of its places they are, from the words' hashes and the texts' offsets in them."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first, least, part = _anchors(h, owner, n)
    # A run is an anchor where the largest of the least hashes of the windows that hold it is its own.
    m = n - max(1, n // 4) + 1
    wide = np.zeros(len(h) - n + 1 + 2 * (m - 1), U64)
    wide[m - 1 + first] = least
    place = np.flatnonzero(_sliding(np.maximum, wide, m) == part)
    order = np.lexsort((part[place], owner[place]))
    text, value = owner[place[order]], part[place[order]]
    one = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])))[: len(text)])
    return text[one], value[one].view(np.int64), np.diff(np.append(one, len(text))).astype(np.int32)


def _text_anchors(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_distinct_anchors() of texts."""
    starts, ends, at = words(data, off)
    return _distinct_anchors(hashes(data, starts, ends), at, n)


def _repeated_windows(data: np.ndarray, off: np.ndarray, hits: np.ndarray, salts: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows whose anchor is among the hits: (text, first word, anchor, its salts) of each, and the offsets and hashes of their windows."""
    starts, ends, at = words(data, off)
    if len(starts) < n or not len(hits):
        return tuple(np.zeros(k, t) for k, t in ((0, np.int64), (0, np.int32), (0, U64), (0, np.int64), (1, np.int32), (0, U64)))
    hits, one = np.unique(hits, return_index=True)
    salts = salts[one]
    h, owner = hashes(data, starts, ends), np.repeat(np.arange(len(off) - 1), np.diff(at))
    first, least, _ = _anchors(h, owner, n)
    # An anchor that another text of the slice has among its hits only adds windows to compare.
    again = np.isin(least, hits)
    first, least = first[again], least[again]
    text = owner[first]
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (first[1:] != first[:-1] + 1) | (least[1:] != least[:-1])))[: len(text)])
    return text[new], (first[new] - at[text[new]]).astype(np.int32), least[new], salts[np.searchsorted(hits, least[new])], np.append(new, len(text)).astype(np.int32), _runs(h, n)[first]


class _Seen:
    """Tells the windows that came before, of stretches (row, anchor, salt, first word, hot, windows' hashes) sorted by anchor, salt and place."""

    def __init__(self) -> None:
        self.key, self.place, self.hashes = None, None, np.zeros(0, U64)

    def later(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """(row, starts: first words of windows seen before; and of hot stretches their anchor and the other windows)."""
        row, at, lists = batch.column(0), batch.column(3).to_numpy(), batch.column(5)
        anchor, salt, hot = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
        text = row.field(1).to_numpy(zero_copy_only=False)
        before = self.key or (None, None)
        new = np.concatenate(([(anchor[0], salt[0]) != before], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])))
        # Equal rows come one after another and are one.
        same = np.concatenate(([not new[0] and (text[0], at[0]) == self.place], ~new[1:] & (text[1:] == text[:-1]) & (at[1:] == at[:-1])))
        group, size = np.cumsum(new), lists.value_lengths().to_numpy()
        owner, value = np.repeat(np.arange(len(at)), size), lists.flatten().to_numpy().view(U64)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        used = ~same[owner]
        owner, value, inside = owner[used], value[used], inside[used]
        of = group[owner]
        order = np.lexsort((value, of))
        late = np.zeros(len(owner), bool)
        late[order[1:]] = (value[order[1:]] == value[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        late |= (of == 0) & np.isin(value, self.hashes)
        kept = value[~late & (of == group[-1])]
        self.hashes = np.union1d(self.hashes, kept) if group[-1] == 0 else kept
        self.key, self.place = (anchor[-1], salt[-1]), (text[-1], at[-1])
        word, rest = (at[owner] + inside).astype(np.int32), ~late & hot[owner]
        give = np.flatnonzero(np.bincount(owner, late | rest, len(at)))
        list_of = lambda of, x: pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(owner[of], give), np.count_nonzero(of)).astype(np.int32)), pa.array(x[of]))
        return pa.RecordBatch.from_arrays([row.take(pa.array(give)), batch.column(1).take(pa.array(give)), list_of(late, word), list_of(rest, word), list_of(rest, value.view(np.int64))], ["row", "a", "starts", "others", "hashes"])


def near_keys(rows: DataFrame, name: Column, keys: DataFrame) -> DataFrame:
    """rows with the column __near: whether the row's name may be among the keys' rows (a column row), by a filter of bounded size."""
    return joins.marked(rows.withColumn("__k", F.xxhash64(name)), keys.select(F.xxhash64("row").alias("__k")), "__k", "__near").drop("__k")


def later_windows(rows: DataFrame, firsts: DataFrame, n: int) -> DataFrame:
    """Rows (row, starts): the first words of a text's windows of n words that also start at an earlier position, of rows (row, text).

    row: a struct (id, text's hash); firsts: rows of cut_texts(), with anchors, of the first of equal texts, the only one looked through.
    """
    if n < 2:
        raise ValueError("a window has 2 words or more")
    kind = rows.schema["row"].dataType.simpleString()

    @tidy
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches, "text"):
            text, first, a, salts, at, h = _repeated_windows(data, off, part.column(2).flatten().to_numpy().view(U64), part.column(3).flatten().to_numpy(), n)
            salt = mix(part.column(0).field(1).to_numpy(zero_copy_only=False).view(U64)[text] + first.astype(U64) * _GOLD) % salts.astype(U64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(a.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(first), pa.array(salts > 1), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["row", "a", "salt", "at", "hot", "h"])

    @tidy
    def seen_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            if batch.num_rows:
                yield seen.later(batch)

    seen = firsts.select("row", F.explode("anchors").alias("x"))
    again = seen.groupBy("x.a").agg(F.max("x.many").alias("many"), F.count("*").alias("n")).where("n > 1 or many > 1")
    again = cut_lineage(again.select("a", F.ceil(F.col("n") / HOT).alias("salts")))
    hits = seen.select("row", "x.a").join(again, "a").select("row", "a", "salts").repartition("row")
    picks = cut_lineage(hits.groupBy("row").agg(F.collect_list("a").alias("hits"), F.collect_list("salts").alias("salts")))
    near = near_keys(rows, F.col("row"), picks).where("__near")
    found = near.join(picks, "row").select("row", "text", "hits", "salts").mapInArrow(windows, f"row {kind}, a bigint, salt int, at int, hot boolean, h array<bigint>")
    # The windows of an anchor meet, in order of place. Those of a frequent one are dealt over salts, and what is not seen
    # before in its salt meets window by window, a row from each salt at most.
    dealt = found.repartition("a", "salt").sortWithinPartitions("a", "salt", "row", "at")
    found = cut_lineage(dealt.mapInArrow(seen_before, f"row {kind}, a bigint, starts array<int>, others array<int>, hashes array<bigint>"))
    others = found.where(F.size("others") > 0).select("row", "a", F.inline(F.arrays_zip(F.col("others").alias("at"), F.col("hashes").alias("h"))))
    place = F.struct("row", "at")
    src = F.first(place).over(Window.partitionBy("a", "h").orderBy("row", "at"))
    others = others.withColumn("late", place != src).where("late").groupBy("row").agg(F.collect_set("at").alias("starts"))
    late = found.where(F.size("starts") > 0).select("row", "starts").unionByName(others)
    return late.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def without(text: bytes, gone: np.ndarray, starts: np.ndarray, n: int) -> tuple[bytes, int]:
    """The text without the lines gone and the windows of n words from starts, and how many whole lines went. Time grows with the text alone.

    A line whose every word goes, goes. A deleted word takes the white space after it along, or, at the line's end, that
    before it.
    """
    data = np.frombuffer(text, np.uint8)
    breaks = np.flatnonzero(data == 10)
    count = len(breaks) + 1
    if len(gone) == count:
        return b"", count
    word, end, _ = words(data, np.array([0, len(data)]))
    line = np.searchsorted(breaks, word)
    first, last = np.concatenate(([0], breaks + 1)), np.append(breaks, len(data))

    def covered(size: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        steps = np.bincount(begins, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
        return np.cumsum(steps[:size]) > 0

    lost = covered(len(word), starts, np.minimum(starts + n, len(word)))
    dropped = np.bincount(line, ~lost, count) == 0
    dropped &= np.bincount(line, minlength=count) > 0
    dropped[gone] = True
    cut = np.flatnonzero(lost & ~dropped[line])
    # The last word that stays in each word's line.
    stays = np.full(count, -1)
    np.maximum.at(stays, line[~lost], np.flatnonzero(~lost))
    inner = cut < stays[line[cut]]
    a, b = np.where(inner, word[cut], end[cut - 1]), np.where(inner, word[np.minimum(cut + 1, len(word) - 1)], end[cut])
    kept = np.flatnonzero(~dropped)
    # A break stays after a line that stays, but for the last of these.
    broken = np.ones(count, bool)
    broken[kept[:-1]] = False
    broken = np.flatnonzero(broken[:-1])
    away = np.flatnonzero(dropped)
    mask = covered(len(data), np.concatenate((a, first[away], breaks[broken])), np.concatenate((b, last[away], breaks[broken] + 1)))
    return data[~mask].tobytes(), len(away)


def _without(text: Column, n: int) -> Column:
    """without() of a column, with its lists __gone and __starts, either null where nothing of the kind goes."""

    @F.arrow_udf("text string, dropped int")
    def cut(texts: pa.Array, gone: pa.Array, starts: pa.Array) -> pa.Array:
        out = [(None, 0)] * len(texts)
        whole = texts.cast(pa.large_binary())
        for k in np.flatnonzero(pc.and_(pc.is_valid(whole), pc.or_(pc.is_valid(gone), pc.is_valid(starts))).to_numpy(zero_copy_only=False)).tolist():
            lists = [x.slice(k, 1).flatten().to_numpy().astype(np.int64) for x in (gone, starts)]
            out[k] = without(whole[k].as_buffer(), *lists, n)
        left = pa.array([x[0] for x in out], pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([left, pa.array([x[1] for x in out], pa.int32())], ["text", "dropped"])

    # Not run again for each filter on the result.
    return cut.asNondeterministic()(text.cast("string"), F.col("__gone"), F.col("__starts"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, inline_words: int | None = None) -> DataFrame:
    """docs without the lines of later copies, and columns lines and dropped_lines (their numbers).

    With inline_words, passages of so many words or more go also where they are not whole lines.
    """
    # A row is named by its id, or, where ids are null or repeat, also by its text; equal rows share their deletions.
    name = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text"))
    docs = docs.drop("lines", "dropped_lines", "__row", "__gone", "__starts", "__cut", "__of", "__k", "__near")
    rows = docs.select(name.alias("row"), F.col(text_col).cast("string").alias("text"))
    firsts, copies = first_texts(cut_lineage(cut_texts(rows, inline_words)))  # read several times
    gone = later_copies(_lines(firsts), min_words).groupBy("row").agg(F.collect_set("line").alias("__gone"))
    none = F.lit(None).cast("array<int>")
    starts = none
    if inline_words is not None:
        gone = gone.join(later_windows(rows.where(F.col("text").isNotNull()), firsts, inline_words).withColumnRenamed("starts", "__starts"), "row", "full")
        starts = F.when(F.col("size").between(inline_words, min_words - 1), F.sequence(F.lit(0), (F.col("size") - inline_words).cast("int")))
    else:
        gone = gone.withColumn("__starts", none)
    # A later copy of a whole text loses all its lines, if it has so many words, or all its windows.
    whole = copies.where("first = 0").select("row", F.when(F.col("size") >= min_words, F.sequence(F.lit(0), F.col("count") - 1)).alias("__gone"), starts.alias("__starts"))
    gone = gone.unionByName(whole.where("__gone is not null or __starts is not null").dropDuplicates(["row"]))
    gone = cut_lineage(gone)
    lines = F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0)).alias("lines")

    def cleaned(source: DataFrame) -> DataFrame:
        joined = source.withColumn("__row", name).join(gone.withColumnRenamed("row", "__of"), F.col("__row").eqNullSafe(F.col("__of")), "left")
        joined = joined.withColumn("__cut", _without(F.col(text_col), inline_words or 1))
        changed = F.col("__gone").isNotNull() | F.col("__starts").isNotNull()
        return joined.select(*[F.when(changed, F.col("__cut.text")).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in docs.columns], lines, F.coalesce("__cut.dropped", F.lit(0)).alias("dropped_lines"))

    # Texts without a deletion need not be shuffled, but for the few that the filter takes for others.
    near = near_keys(docs, name, gone)
    clean = near.where("not __near").select(*docs.columns, lines, F.lit(0).alias("dropped_lines"))
    return clean.unionByName(cleaned(near.where("__near").drop("__near")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = drop_repeated_lines(docs, inline_words=MIN_WORDS)
    return found.select("doc_id", "lines", "dropped_lines", F.octet_length("text").cast("long").alias("n_bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
