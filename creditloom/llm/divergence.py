"""Source divergence audit: how far the word use of a language's sources lies apart, exactly.

A language keeps the terms that at least min_docs of its documents hold. Every (lang, source) group and each language as a
whole gives a kept term p = 1 + floor(1e9 (count + 2) / (N + 2 V)); N counts the kept terms' occurrences, V the kept
terms. Two such values lie f(p, q) = floor((p - q)^2 / (p + q)) apart. A pair's value is the sum of f over all kept terms,
in whole numbers, without rounding.

Heavy-light split: a term that more than HEAVY_SHARE of a language's groups hold is heavy. Let p0 be a group's value for a
term it doesn't hold. A pair's sum is V f(p0, q0), plus what each term that either holds adds to that:
- heavy terms, as dense numpy tiles of terms by groups, f(p, q) - f(p0, q0) each;
- light ones, held by s: m f(p, q0) - m f(p0, q0) for each value p and the number m of the terms to which s gives it, against
  all other groups at once; and for the pairs of postings of one term, where both hold it, the correction
  f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).
The parts are integers, so their sum is exact whatever terms are heavy.

Terms are cut out of whole texts in Arrow batches; a batch sends a row for each (lang, source, term) it holds, so neither a
frequent term nor a large group gathers more than a row a batch. The kept terms' counts are checkpointed. Pairs are worked
out in tasks of about BUCKET_ROWS postings of whole terms (dealt by the term's hash) by TILE groups against TILE groups,
which send a row a pair; so neither a language nor a source is one task. The ten best terms of a group are found in part
before they meet. What is broadcast is left to Spark's own threshold: a row a group.

Null text, lang and source are ''. A text without terms still makes its group occur. Repeated rows are documents of their
own. Ties rank by the item's UTF-8 bytes. A language with one source has no pairs; without kept terms pairs are 0. Empty
tables give no rows. Very long texts are cut in one task, as whole texts. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytesops import LOWER, cut_lineage, slices, tidy

MIN_DOCS, TOP, HEAVY_SHARE, BUCKET_ROWS, TILE, CELLS, SLICE_BYTES = 10, 10, 0.25, 200_000, 256, 1 << 21, 8 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def cut_terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of texts, one after another, A-Z lower-cased, and the text of each."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _LETTER[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    letters = LOWER[data[inside[1:-1]]]
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return terms, np.searchsorted(off, starts, side="right") - 1


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences and documents, from rows (lang, source, text)."""
    names = ["lang", "source", "term", "n", "docs"]

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches, "text", SLICE_BYTES):
            terms, text = cut_terms(data, off)
            coded = terms.dictionary_encode()
            kinds, term = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
            both, many = np.unique(text * max(kinds, 1) + term, return_counts=True)
            lang, source = (part.column(k).dictionary_encode() for k in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy()
            keys, of = np.unique(group[both // max(kinds, 1)] * max(kinds, 1) + both % max(kinds, 1), return_inverse=True)
            group, term = keys // max(kinds, 1), pa.array(keys % max(kinds, 1))
            width = max(len(source.dictionary), 1)
            yield pa.RecordBatch.from_arrays([
                lang.dictionary.take(pa.array(group // width)), source.dictionary.take(pa.array(group % width)), coded.dictionary.take(term).cast(pa.string()),
                pa.array(np.bincount(of, many, len(keys)).astype(np.int64)), pa.array(np.bincount(of, minlength=len(keys)).astype(np.int64)),
            ], names)

    found = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    # Dealt by the term alone, so that all sources of a term are together from here on.
    return found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str) -> F.Column:
    """p of a count, in whole numbers of any size."""
    return F.expr(f"1 + (cast(1000000000 as decimal(20, 0)) * cast({count} + 2 as decimal(18, 0))) div (cast({total} as decimal(20, 0)) + 2 * cast({terms} as decimal(18, 0)))").cast("long")


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f(p, q) of whole numbers up to 1e9 + 1."""
    d = p - q
    return d * d // (p + q)


def tile_sums(left: np.ndarray, right: np.ndarray, absent: dict[str, np.ndarray], postings: dict[str, np.ndarray], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(s, t, sum) of pairs s < t, s of the groups left and t of right: what these postings add, and f(p0, q0) times terms.

    absent: group, p0; postings: term, group, p, heavy, in order of the terms.
    """
    p0 = np.zeros(int(absent["group"].max()) + 1, np.int64)
    p0[absent["group"]] = absent["p"]
    sums = apart(p0[left][:, None], p0[right][None]) * terms
    row, column = (np.full(len(p0), -1) for _ in range(2))
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    term, group, p, heavy = (postings[k] for k in ("term", "group", "p", "heavy"))
    at = np.unique(term, return_index=True)[1]
    size = np.diff(np.append(at, len(term)))
    none = apart(p0[left][:, None], p0[right][None])

    # Heavy terms: dense tiles, so many terms at once that a row of groups against the other groups has CELLS at most.
    dense = np.flatnonzero(heavy[at]) if len(at) else at
    step = max(1, CELLS // max(len(left), len(right)))
    for k in range(0, len(dense), step):
        own = dense[k : k + step]
        which = np.repeat(np.arange(len(own)), size[own])
        take = np.concatenate([np.arange(a, a + b) for a, b in zip(at[own], size[own], strict=True)])
        tiles = []
        for side, place in ((left, row), (right, column)):
            tile = np.tile(p0[side], (len(own), 1))
            here = place[group[take]] >= 0
            tile[which[here], place[group[take[here]]]] = p[take[here]]
            tiles.append(tile)
        for i in range(len(left)):
            sums[i] += apart(tiles[0][:, i : i + 1], tiles[1]).sum(0) - none[i] * len(own)

    # Light ones: values of a group against the others' p0, then the pairs of a term's postings.
    light = ~heavy
    for turned, place, other in ((sums, row, right), (sums.T, column, left)):
        here = np.flatnonzero(light & (place[group] >= 0))
        order = here[np.lexsort((p[here], group[here]))]
        new = np.flatnonzero(np.concatenate(([True], (group[order[1:]] != group[order[:-1]]) | (p[order[1:]] != p[order[:-1]])))[: len(order)])
        many = np.diff(np.append(new, len(order)))
        rows = max(1, CELLS // max(1, len(other)))
        for k in range(0, len(new), rows):
            one, m = order[new[k : k + rows]], many[k : k + rows]
            added = (apart(p[one][:, None], p0[other][None]) - apart(p0[group[one]][:, None], p0[other][None])) * m[:, None]
            np.add.at(turned, place[group[one]], added)
    for distance in range(1, int(size[~heavy[at]].max()) if len(at) and (~heavy[at]).any() else 0):
        # Postings of a term so far apart in its list.
        i = np.flatnonzero(light[:-distance] & (term[distance:] == term[:-distance]))
        for a, b in ((i, i + distance), (i + distance, i)):
            fits = (row[group[a]] >= 0) & (column[group[b]] >= 0)
            a, b = a[fits], b[fits]
            pa_, pb, a0, b0 = p[a], p[b], p0[group[a]], p0[group[b]]
            np.add.at(sums, (row[group[a]], column[group[b]]), apart(pa_, pb) - apart(pa_, b0) - apart(a0, pb) + apart(a0, b0))
    s, t = np.nonzero(left[:, None] < right[None])
    return left[s], right[t], sums[s, t]


def pair_sums(groups: DataFrame, postings: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows (lang, s, t, value) for s < t.

    groups: (lang, group, p0, terms, tiles, buckets), numbered from 0 in each lang; postings: (lang, term, group, p, heavy,
    tiles, buckets).
    """

    def tiled(df: DataFrame) -> DataFrame:
        """A row for each pair of tiles that its group's tile is in."""
        own = F.floor(F.col("group") / tile).cast("int")
        return df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"a": F.least(own, "other"), "b": F.greatest(own, "other")})

    key, none = ["lang", "bucket", "a", "b"], F.lit(None).cast("long")
    head = tiled(groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))))
    head = head.select(*key, none.alias("term"), "group", F.col("p0").alias("p"), F.lit(False).alias("heavy"), F.when(F.col("bucket") == 0, F.col("terms")).otherwise(0).alias("terms"))
    body = tiled(postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")))
    body = body.select(*key, F.xxhash64("term", F.lit(7)).alias("term"), "group", "p", "heavy", F.lit(0).cast("long").alias("terms"))

    def sums(table: pa.Table) -> pa.Table:
        lang, a, b = (table.column(k)[0].as_py() for k in ("lang", "a", "b"))
        first = pc.is_null(table.column("term"))
        own, rest = table.filter(first), table.filter(pc.invert(first)).sort_by("term")
        absent = {"group": own.column("group").to_numpy(), "p": own.column("p").to_numpy()}
        sides = [np.sort(absent["group"][absent["group"] // tile == k]) for k in (a, b)]
        s, t, value = tile_sums(*sides, absent, {k: rest.column(k).to_numpy() for k in ("term", "group", "p", "heavy")}, own.column("terms")[0].as_py())
        return pa.table({"lang": pa.array([lang] * len(s), pa.string()), "s": s, "t": t, "value": value})

    parts = head.unionByName(body).groupBy(*key).applyInArrow(sums, "lang string, s bigint, t bigint, value bigint")
    return parts.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, heavy_share: float = HEAVY_SHARE, bucket_rows: int = BUCKET_ROWS, tile: int = TILE) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): `pair` for each other source of the language, `term` for the top terms that the source uses more than its language."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"df": F.sum("docs").over(of_term), "all": F.sum("n").over(of_term), "held": F.count("*").over(of_term), "lead": F.col("source") == F.min("source").over(of_term)})
    counts = cut_lineage(counts.where(F.col("df") >= min_docs).select("lang", "term", "source", "n", "all", "held", "lead"))

    # A row a group: its totals, its number in its language, and how the language's postings are dealt.
    lead = lambda column: F.sum(F.when(F.col("lead"), column).otherwise(0))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), lead(F.lit(1)).alias("leads"), lead(F.col("all")).alias("all"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total", "rows", "leads", "all"])
    # Windows over a language's sources; no text or term is in them.
    in_lang = Window.partitionBy("lang")
    groups = groups.withColumns({
        "group": (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long"), "groups": F.count("*").over(in_lang),
        "terms": F.sum("leads").over(in_lang), "lang_total": F.sum("all").over(in_lang), "rows": F.sum("rows").over(in_lang),
    }).withColumn("tiles", F.ceil(F.col("groups") / tile).cast("int"))
    groups = groups.withColumns({"buckets": F.greatest(F.lit(1), F.ceil(F.col("rows") * F.col("tiles") / bucket_rows)).cast("int"), "p0": F.when(F.col("terms") > 0, _share("0", "total", "terms")).otherwise(1)})
    groups = cut_lineage(groups.select("lang", "source", "group", "groups", "total", "terms", "lang_total", "p0", "tiles", "buckets"))

    postings = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))
    postings = cut_lineage(postings.select("lang", "source", "term", "group", "p", _share("all", "lang_total", "terms").alias("q"), (F.col("held") > heavy_share * F.col("groups")).alias("heavy"), "tiles", "buckets"))

    value = F.expr("(p - q) * (p - q) div (p + q)")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    sums = pair_sums(groups, postings, tile)
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("s").alias("group"), F.col("t").alias("other")), F.struct(F.col("t").alias("group"), F.col("s").alias("other")))).alias("pair"), "value").select("lang", "pair.*", "value")
    names = groups.select("lang", "source", "group")
    pairs = both.join(names, ["lang", "group"]).join(names.select("lang", F.col("source").alias("item"), F.col("group").alias("other")), ["lang", "other"])
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(by_value))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
with docs as (
    select row_number() over () as row, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') as text from documents
), tokens as (
    select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from docs
), kept as (
    select lang, term, count(*) n from tokens group by lang, term having count(distinct row) >= 10
), langs as (select lang, sum(n) total, count(*) terms from kept group by lang
), counts as (select lang, source, term, count(*) n from tokens semi join kept using (lang, term) group by all
), groups as (
    select g.lang, g.source, coalesce(c.total, 0) total, coalesce(l.terms, 0) terms
    from (select distinct lang, source from docs) g
    left join (select lang, source, sum(n) total from counts group by all) c on g.lang = c.lang and g.source = c.source
    left join langs l on g.lang = l.lang
), shares as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total::hugeint + 2 * g.terms) p,
        1 + (1000000000::hugeint * (k.n + 2)) // (l.total::hugeint + 2 * l.terms) q
    from groups g join kept k using (lang) join langs l using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pairs as (
    select a.lang, a.source, b.source item, coalesce(f.value, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join (
        select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
        from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
    ) f on f.lang = a.lang and f.source = a.source and f.item = b.source
), found as (
    select lang, source, 'pair' part, item, value from pairs
    union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from shares where n > 0 and p > q
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) rank from found) where part = 'pair' or rank <= 10
"""
