"""Near-duplicate documents: MinHash with tensored banding, links confirmed on whole shingle sets.

A document has two small collections of m half-keys, each of two minhashes, and a table key for each pair of a
half-key of the first and one of the second: m * m tables of four minhashes from 4 m minhashes. m is chosen so that
two documents at the threshold share no table with a probability of MISS at most.

Documents of equal sets form a class, represented by its smallest id, before anything is paired. Inside a table key,
classes are first paired with one leader; whole sets confirm the pairs, and connected classes get one component. What
is left are classes that share a key with one of another component. Those are matched by the rarest shingles of each:
two sets over the threshold have a common shingle among them, at places that leave room for the overlap needed. Pairs
that pass are confirmed as well, so nothing of a group that the leaders have joined is paired out, and no link between
components is lost.

Words are lower-cased for A-Z. Documents without words, and null texts, have an empty set and are linked with nothing.
Rows of a null id are returned with a null component, and kept. Rows that share an id are one document, also with
different texts: each row has its own set's size, a link of one of the texts links the id, and so texts that are close to
nothing of each other can meet in one component; the rows share component_id and kept. Very long texts are held as whole
sets. Ties do not arise, as the smallest id stands for a group. An empty table gives no rows. Shingles are held as 64-bit
hashes. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytesops import cut_lineage, hashes, mix, slices, tidy, U64, words

MISS, LIST_ROWS = 1e-4, 256
_SEEDS = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' word k-grams (with fewer words, of all their words), repeats included, and the texts' offsets in them."""
    starts, ends, of = words(data, off)
    h = hashes(data, starts, ends, lower=True)
    size = np.diff(of)
    full = np.zeros(max(0, len(h) - k + 1), U64)
    for j in range(k):
        full += h[j : j + len(full)] * (_SEEDS[j] | U64(1))
    full = mix(full + U64(k))
    many = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    at = np.concatenate(([0], np.cumsum(many)))
    out = np.empty(at[-1], U64)
    long_ = size >= k
    place = np.repeat(long_, many)
    last = np.repeat(of[:-1] - at[:-1], many) + np.arange(at[-1])
    out[place] = full[last[place]]
    for row in np.flatnonzero(~long_ & (size > 0)):
        own = h[of[row] : of[row + 1]]
        out[at[row]] = mix((own * (_SEEDS[: len(own)] | U64(1))).sum(keepdims=True, dtype=U64) + U64(len(own)))[0]
    return out, at


def distinct_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, one text after another, and offsets."""
    s, at = shingles(data, off, k)
    sets = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return (np.concatenate(sets) if sets else s), np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)


def halves_for(threshold: float) -> int:
    """Half-keys in a collection: two documents at the threshold meet in no table with a probability of MISS at most."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - threshold**2))


def half_keys(s: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """(texts, 2 m) keys of two minhashes each, for non-empty sets."""
    out = np.empty((len(at) - 1, 2 * m), U64)
    for j in range(2 * m):
        pair = [np.minimum.reduceat((s ^ _SEEDS[2 * j + i]) * (_SEEDS[128 + 2 * j + i - 1] | U64(1)), at[:-1]) for i in (0, 1)]
        out[:, j] = mix(pair[0] * U64(0x9E3779B97F4A7C15) + pair[1])
    return out


def signatures(docs: DataFrame, k: int, m: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, fp1, fp2, halves): set size, a fingerprint of the set, and the half-keys (null for an empty set)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches, "text"):
            s, at = distinct_sets(data, off, k)
            n = np.diff(at)
            full = np.flatnonzero(n)
            prints, keys = np.zeros((2, part.num_rows), U64), [None] * part.num_rows
            if len(full):
                for i in (0, 1):
                    prints[i, full] = np.add.reduceat(mix(s ^ _SEEDS[250 + i]), at[full])
                for row, key in zip(full, half_keys(s, np.append(at[full], at[-1]), m).view(np.int64), strict=True):
                    keys[row] = key
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in prints), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "fp1", "fp2", "halves"])

    return rows.mapInArrow(sign, "id bigint, n bigint, fp1 bigint, fp2 bigint, halves array<bigint>")


def whole_sets(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, set) of the documents with the given ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id", "left_semi")

    @tidy
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches, "text"):
            s, at = distinct_sets(data, off, k)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(s.view(np.int64)))], ["id", "set"])

    return rows.mapInArrow(collect, "id bigint, set array<bigint>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets meet 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component): the smallest id reachable from each id of the edges (a, b), by label spreading and pointer jumping."""
    arcs = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(arcs.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = arcs.join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").groupBy(F.col("a").alias("id")).agg(F.min("lb").alias("near"))
        moved = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("further"))
        labels_next = cut_lineage(moved.join(jump, "new").select("id", F.col("label").alias("old"), F.least("new", "further").alias("label")))
        labels = labels_next.select("id", "label")
        if labels_next.where(F.col("old") != F.col("label")).isEmpty():
            return labels.withColumnRenamed("label", "component")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for each row of docs."""
    m = halves_for(percent / 100)
    rows = cut_lineage(signatures(docs, k, m, id_col, text_col))
    sized = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = sized.groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.first("halves").alias("halves"), F.count("*").alias("copies"))
    classes = cut_lineage(classes)
    tables = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.transform(F.sequence(F.lit(m), F.lit(2 * m - 1)), lambda j: F.xxhash64(i, j, F.get("halves", i), F.get("halves", j)))))
    keyed = classes.select("rep", "n", F.explode(tables).alias("key"))
    leaders = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("leader"), F.max("rep").alias("other")).where(F.col("leader.rep") != F.col("other"))
    members = cut_lineage(keyed.join(leaders.drop("other"), "key"))
    close = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))  # noqa: E731  else the sizes alone rule a link out
    first = members.where((F.col("rep") != F.col("leader.rep")) & close(F.col("n"), F.col("leader.n"))).select(F.col("rep").alias("a"), F.col("leader.rep").alias("b")).distinct()
    sets = cut_lineage(whole_sets(docs, members.select(F.col("rep").alias("id")).distinct(), k, id_col, text_col))
    edges = cut_lineage(confirm(first, sets, percent))
    found = components(edges)
    # Keys that hold classes of several components.
    placed = members.select("key", "rep", "n").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where(F.col("c1") != F.col("c2")).select("key")
    open_ = cut_lineage(placed.join(mixed, "key", "left_semi").select(F.col("rep").alias("id"), "n", "component").distinct())
    second = across(open_, sets, percent)
    more = cut_lineage(confirm(second.join(first, ["a", "b"], "left_anti"), sets, percent))
    if not more.isEmpty():
        found = components(edges.union(more))
    return _assign(rows, classes, found)


def across(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of the rows (id, n, component) that may be linked and lie in different components.

    Shingles are ordered by how many of the rows hold them. The first common shingle of two sets, at places pa and pb of
    na and nb, leaves an overlap of at most min(na - pa, nb - pb), so places beyond what the threshold allows are left
    out, and so are pairs without that room. Shingles of one row alone come first and match nothing; they only count.
    The most frequent component of a shingle's rows never meets itself.
    """
    held = open_.join(sets, "id").select("id", "n", "component", F.explode("set").alias("s"))
    often = held.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = held.join(often, "s")
    row, order = Window.partitionBy("id"), Window.partitionBy("id").orderBy("df", "s")
    placed = shared.withColumn("p", F.col("n") - F.count("*").over(row) + F.row_number().over(order) - 1)
    room = lambda n, p, other: (n - p) * (100 + percent) >= percent * (n + other)
    # The smallest set that may be linked to one of n has percent * n / 100 shingles.
    least = 100 * (F.col("n") - F.col("p")) * (100 + percent) >= percent * F.col("n") * (100 + percent)
    lists = cut_lineage(placed.where(least).select("s", "id", "n", "component", "p"))
    most = lists.groupBy("s", "component").agg(F.count("*").alias("k")).groupBy("s").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("several"), F.sum("k").alias("rows"))
    most = most.where("several > 1").select("s", "main", F.ceil(F.col("rows") / LIST_ROWS).cast("int").alias("parts"))
    here = cut_lineage(lists.join(most, "s"))
    # A frequent shingle's list is dealt over parts of about LIST_ROWS, and each row to be matched goes to all of them.
    columns = lambda i: (F.col(c).alias(f"{c}{i}") for c in ("id", "n", "component", "p"))
    a = here.where("component <> main").select("s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *columns(1))
    b = here.select("s", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), *columns(2))
    fits = (F.col("component1") != F.col("component2")) & room(F.col("n1"), F.col("p1"), F.col("n2")) & room(F.col("n2"), F.col("p2"), F.col("n1"))
    return a.join(b, (a["s"] == b["s"]) & (a["part"] == b["part"]) & fits).select(F.greatest("id1", "id2").alias("a"), F.least("id1", "id2").alias("b")).distinct()


def _assign(rows: DataFrame, classes: DataFrame, found: DataFrame, salts: int = 16) -> DataFrame:
    """Each row's component by way of its class; classes of several documents or with links are few, and are salted."""
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").where(F.col("component").isNotNull() | (F.col("copies") > 1))
    named = named.select("fp1", "fp2", "n", F.coalesce("component", "rep").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(named, ["fp1", "fp2", "n", "salt"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, k=3, percent=85).withColumnRenamed("id", "doc_id")


OP5_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from d),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a.doc_id as x, b.doc_id as y
  from s a join s b on a.s = b.s and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r(id, c) as (select doc_id, doc_id from documents union select l.y, r.c from r join links l on l.x = r.id),
m as (select id, min(c) as c from r group by id)
select doc_id, coalesce(n, 0) as n_shingles, c as component_id, doc_id = c as kept
from documents left join n using (doc_id) join m on m.id = doc_id
"""
