"""How far sources of one language are apart in their use of words: counts and distances on Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.session import staged

# what separates terms: fixed by the contract of the query
BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000  # probabilities are whole numbers of this size, plus one
PRIOR = 5  # added to every count
HELD_ROWS = 600_000  # partial counts a task gathers before it hands them on
SHARD_CELLS = 1 << 15  # cells of one shard of the matrix of sources by terms, if its sources are few
BLOCK = 256  # sources one task holds against as many others
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """Per (lang, source, term) of a batch the occurrences and the documents; a row with an empty term per group."""
    lists = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), BREAK)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    terms, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(terms), 0)
    coded = pc.dictionary_encode(terms.filter(full))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    seen = pa.table({"row": row.filter(full), "code": coded.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    groups = pa.array(np.arange(batch.num_rows))
    found = pa.table(
        {
            "lang": batch["lang"].take(seen["row"]), "source": batch["source"].take(seen["row"]),
            "code": seen["code"], "n": seen["count_all"],
        }
    ).group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    counted = pa.table(
        [found["lang"], found["source"], pc.take(coded.dictionary, found["code"]).cast(pa.string()), found["n_sum"].cast(pa.int64()), found["n_count"]],
        schema=_COUNTS,
    )
    marks = pa.table({"lang": batch["lang"], "source": batch["source"], "at": groups}).group_by(["lang", "source"]).aggregate([("at", "count")])
    zero = pa.array(np.zeros(marks.num_rows, np.int64))
    return pa.concat_tables([counted, pa.table([marks["lang"], marks["source"], pa.array([""] * marks.num_rows), zero, zero], schema=_COUNTS)])


def _summed(parts: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return table.rename_columns([c.removesuffix("_sum") for c in table.column_names]).select(_COUNTS.names).cast(_COUNTS)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(_batch_counts(batch))
        rows += parts[-1].num_rows
        if rows > HELD_ROWS:
            parts = [_summed(parts)]
            rows = parts[0].num_rows
            if rows > HELD_ROWS // 2:
                yield from parts[0].to_batches(max_chunksize=50_000)
                parts, rows = [], 0
    if parts:
        yield from _summed(parts).to_batches(max_chunksize=50_000)


def count_terms(docs: DataFrame) -> DataFrame:
    """Occurrences `n` and documents `docs` of each term per `lang` and `source`; nulls count as empty text.

    A group without a term has a row with the empty term, and so has every other group.
    """
    plain = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return plain.mapInArrow(_partial_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact, as a long; null without terms."""
    over = F.nullif(total + F.lit(PRIOR) * terms, F.lit(0)).cast("decimal(20,0)")
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + F.lit(PRIOR)).cast("decimal(19,0)")
    return F.call_function("div", scaled, over) + F.lit(1).cast("bigint")


def _distances(table: pa.Table, block: int) -> pa.Table:
    """Summed distances over one shard between the sources of two blocks of `block` sources.

    Rows without a term name the sources of the blocks, with the probability of a term they lack; the
    others are the cells of the shard.
    """
    lang, first, second = (table[c][0].as_py() for c in ("lang", "first", "second"))
    named = pc.is_null(table["term"])
    heads = table.filter(named)
    cells = table.filter(pc.invert(named))
    no, p = heads["no"].to_numpy(), heads["p"].to_numpy()
    order = np.argsort(no)
    no, p = no[order], p[order]
    columns = pc.dictionary_encode(cells["term"]).combine_chunks()
    if isinstance(columns, pa.ChunkedArray):
        columns = columns.chunk(0) if columns.num_chunks else pa.array([], pa.string()).dictionary_encode()
    width = len(columns.dictionary)
    matrix = np.repeat(p[:, None], max(width, 1), axis=1)
    if width:
        matrix[np.searchsorted(no, cells["no"].to_numpy()), columns.indices.to_numpy()] = cells["p"].to_numpy()
    else:
        matrix[:] = 0
    rows = np.flatnonzero(no // block == first)
    cols = np.flatnonzero(no // block == second)
    a, b, value = [], [], []
    for i in rows:
        others = cols[cols > i] if first == second else cols
        a.append(np.full(len(others), no[i]))
        b.append(no[others])
        value.append(np.abs(matrix[others] - matrix[i]).sum(axis=1))
    n = sum(map(len, a))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "a": join(a), "b": join(b), "value": join(value)})


def _pairs(cells: DataFrame, groups: DataFrame, block: int, shard_cells: int) -> DataFrame:
    """`(lang, a, b, value)`: the distance of the sources numbered `a` < `b` of a language.

    The matrix of sources by terms is cut into shards of terms and blocks of sources; a task holds one
    shard of two blocks. Shards come from the number of terms and sources, so their size is bounded.
    """
    # a shard gives a row per pair of its sources, so it holds at least as many terms
    held = F.least("sources", F.lit(2 * block))
    shards = F.greatest(F.ceil(F.col("terms") * held / F.greatest(F.lit(shard_cells), held * held)), F.lit(1)).cast("int")
    blocks = F.ceil(F.col("sources") / F.lit(block)).cast("int")

    def to_blocks(frame: DataFrame) -> DataFrame:
        own = F.floor(F.col("no") / F.lit(block)).cast("int")
        other = frame.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return other.select("lang", "no", "term", "p", "shard", F.least("_own", "_other").alias("first"), F.greatest("_own", "_other").alias("second"))

    shard = F.pmod(F.xxhash64("term"), shards).cast("int").alias("shard")
    heads = groups.select("lang", "no", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), "sources", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    body = cells.select("lang", "no", "term", "p", "sources", shard)
    both = to_blocks(heads).unionByName(to_blocks(body))
    parts = both.groupBy("lang", "shard", "first", "second").applyInArrow(lambda t: _distances(t, block), "lang string, a bigint, b bigint, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = 30, top: int = 50, block: int = BLOCK, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart.

    Terms are runs of ASCII letters and of characters beyond ASCII; only A to Z are lowered. A language
    keeps the terms that occur in at least `least_docs` of its documents. Tasks count on Arrow columns;
    counts are summed by (lang, source, term), and the columns of kept terms go in shards to tasks that
    add up the distances of all pairs of sources. All arithmetic is on whole numbers.

    Returns lang, source, part, item, value, rank: with part `pair` every other source of the language by
    falling distance, with part `term` the `top` terms whose share in the source exceeds that in the
    language. Null text, lang and source count as empty text; a group without a kept term has pairs but
    no terms, and a language without kept terms has distances of 0. Repeated rows count as often as they
    occur; ties rank by the item's bytes. Long texts are split whole, one Arrow batch at least holding
    one. Other columns are ignored, and an empty table gives no rows.
    """
    counts = staged(count_terms(docs))
    spoken = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    kept = staged(spoken.where(F.col("docs") >= least_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    used = staged(counts.where("term <> ''").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = (
        counts.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        .na.fill(0, ["terms", "lang_total", "total"])
        .withColumn("no", (F.row_number().over(numbered) - 1).cast("bigint"))
        .withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    )
    absent = F.coalesce(probability(F.lit(0), F.col("total"), F.col("terms")), F.lit(0).cast("bigint"))
    groups = staged(groups.withColumn("absent", absent))
    cells = staged(
        used.join(groups, ["lang", "source"]).select(
            "lang", "source", "no", "term", "terms", "sources", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
            probability(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"),
        )
    )
    pairs = staged(_pairs(cells, groups, block, shard_cells))
    names = groups.select("lang", "no", "source")
    both = pairs.select("lang", F.inline(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("other"), "value"), F.struct(F.col("b").alias("no"), F.col("a").alias("other"), "value"))))
    pair = both.join(names, ["lang", "no"]).join(names.select("lang", F.col("no").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    ranks = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(ranks).alias("rank")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    apart = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = apart.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top)
    return pair.unionByName(term)


AUDIT_SQL = r"""
with words as (
  select doc_id, rowid as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as rowid from documents)
),
kept as (
  select lang, term, count(*) as in_lang from words group by all having count(distinct row) >= 30
),
langs as (select lang, count(*) as terms, sum(in_lang) as lang_total from kept group by lang),
cells as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
sums as (select lang, source, sum(n) as total from cells group by all),
groups as (
  select lang, source, coalesce(total, 0)::hugeint as total, coalesce(terms, 0)::hugeint as terms, lang_total::hugeint as lang_total
  from (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents) left join sums using (lang, source) left join langs using (lang)
),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.terms) as p,
    1 + (1000000000::hugeint * (k.in_lang + 5)) // (g.lang_total + 5 * g.terms) as q
  from groups g join kept k using (lang) left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term
),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all
  select a.lang, a.source, 'pair', b.source, 0 from groups a join groups b on a.lang = b.lang and a.source <> b.source where a.terms = 0
  union all
  select lang, source, 'term', term, p - q from shares where n > 0 and p > q
)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from found qualify part = 'pair' or rank <= 50
"""
