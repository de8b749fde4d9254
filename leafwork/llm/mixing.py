"""Copies of documents per source, by pivotal rounding of fractional copy probabilities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.operators.ordering import with_index
from leafwork.session import staged

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BITS = 6  # a node of the reduction tree takes up to 64 fractional documents
SEED = 1
TASK_ROWS = 20_000  # rows one task folds, about
MOST_TASKS = 20_000
TRIES = 16  # draws of a block, of which the one that leaves the least to round counts


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def draw(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on nothing but `parts`, so that reruns agree."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _meet(carried: Column, item: Column, salt: Sequence[Column | str]) -> Column:
    """Move mass between two fractional documents until one is whole.

    Mass is probability times words, so that what one gains in words the other loses. Upwards means
    that `carried` gains. The odds keep both expectations. Returns who is decided (`out`, `up`), who
    goes on (`rest`) and with which mass (`mass`).
    """
    room, other_room = carried["w"] - carried["a"], item["w"] - item["a"]
    gain, loss = F.least(room, item["a"]), F.least(carried["a"], other_room)
    upwards = draw(*salt, carried["rank"], item["rank"]) * (gain + loss) < loss

    def outcome(first: bool, up: int, mass: Column) -> Column:
        out, rest = (carried, item) if first else (item, carried)
        return F.struct(out.alias("out"), F.lit(up).alias("up"), rest.alias("rest"), mass.alias("mass"))

    return F.when(
        upwards,
        F.when(room <= item["a"], outcome(True, 1, item["a"] - room)).otherwise(outcome(False, 0, carried["a"] + item["a"])),
    ).otherwise(
        F.when(carried["a"] <= other_room, outcome(True, 0, item["a"] + carried["a"])).otherwise(
            outcome(False, 1, carried["a"] - other_room)
        )
    )


def _round_block(items: Column, doc_type: str, salt: Sequence[Column | str]) -> Column:
    """Fold a sorted block of `(rank, w, a, doc_id)` to `(carried, done)`; at most one stays fractional.

    `carried.w` is 0 where none does. `done` holds `(doc_id, w, up)` of the documents that are decided.
    """
    item_type = f"struct<rank:bigint,w:bigint,a:double,doc_id:{doc_type}>"
    done_type = f"array<struct<doc_id:{doc_type},w:bigint,up:int>>"
    none = F.expr(f"cast(named_struct('rank', -1L, 'w', 0L, 'a', 0D, 'doc_id', null) as {item_type})")
    start = F.struct(none.alias("carried"), F.array().cast(done_type).alias("done"))

    def decided(item: Column, up: Column) -> Column:
        return F.array(F.struct(item["doc_id"].alias("doc_id"), item["w"].alias("w"), up.cast("int").alias("up")))

    def step(state: Column, item: Column) -> Column:
        def after(met: Column) -> Column:
            rest = met["rest"]
            done = F.concat(state["done"], decided(met["out"], met["up"]))
            whole = (met["mass"] <= 0) | (met["mass"] >= rest["w"])
            going = F.struct(rest["rank"].alias("rank"), rest["w"].alias("w"), met["mass"].alias("a"), rest["doc_id"].alias("doc_id"))
            return F.when(
                whole, F.struct(none.alias("carried"), F.concat(done, decided(rest, met["mass"] > 0)).alias("done"))
            ).otherwise(F.struct(going.alias("carried"), done.alias("done")))

        alone = F.struct(item.alias("carried"), state["done"].alias("done"))
        return F.when(state["carried"]["w"] == 0, alone).otherwise(_let(_meet(state["carried"], item, salt), after))

    return F.aggregate(items, start, step)


def _round_best(items: Column, doc_type: str, seed: int, tries: int) -> Column:
    """`_round_block` with the draw, of `tries`, that leaves the least mass to round."""

    def one(attempt: Column) -> Column:
        return _let(_round_block(items, doc_type, (str(seed), attempt)), lambda s: F.struct(_missing(s["carried"]).alias("miss"), attempt.alias("attempt"), s.alias("s")))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), one))["s"]


def _missing(carried: Column) -> Column:
    return F.when(carried["w"] == 0, F.lit(0.0)).otherwise(F.least(carried["a"], carried["w"] - carried["a"]))


def source_targets(rows: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """Per `source`: its `size`, and the words it is to give (`target`).

    Sources in the order of their code points, null last, have the weights in turn. They share `share`
    times all words by weight; a target stops at `most` times the source's words and the rest is shared
    again by weight, until no target is above. Each round collects three sums, not sources.
    """
    sizes = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    numbered = with_index(sizes, [F.col("source").asc_nulls_last()], "_no")
    turn = F.array(*(F.lit(float(w)) for w in weights))
    weighed = staged(
        numbered.withColumn("_w", F.get(turn, (F.col("_no") % len(weights)).cast("int"))).withColumn("_cap", F.col("source_size") * most)
    )
    budget = (rows.agg(F.sum("size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    full = F.lit(False)
    while budget:
        row = weighed.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0)),
        ).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (budget - row[1]) / row[2]
        full = F.col("_cap") < F.lit(level) * F.col("_w")
    target = F.when(full, F.col("_cap").cast("double")).otherwise(F.lit(level) * F.col("_w"))
    return staged(weighed.select("source", "_no", "source_size", target.alias("target")))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = SEED, tries: int = TRIES
) -> DataFrame:
    """How often each document is taken so that every source gives its target of words.

    A document of a source with target t of s words is taken t / s times in expectation: the whole
    copies at once, the fraction by pivotal rounding. Fractional documents are ranked by source and
    falling size; blocks of 64 neighbours are folded in tasks, each fold meeting two documents at a
    time and moving mass between them until one is whole, and the one that stays fractional goes to
    the next level of the tree. Mass is measured in words, so a source misses its target by no more than
    half of the one document that is left at its root, which goes to the nearer side; a block is drawn
    `tries` times, and the draw counts that leaves the least to round. No block holds more than 64 rows,
    whatever the source's share of the table, and draws depend on seed and ranks alone.

    Returns doc_id, source, size (words), source_size, target, copies and taken (words with repeats). A
    null or empty text and one without words have size 0 and give nothing. A null source is a source of
    its own, the last. Null and repeated ids and repeated rows are rows like others; where rows agree in
    source, size and id it does not matter which is taken. Very long texts are counted whole, natively.
    Other columns are ignored, an empty table gives no rows.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")
    rows = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), size))
    targets = source_targets(rows, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = targets.select(F.col("source").alias("_source"), "_no", "source_size", "target", ratio.alias("_ratio"))
    known = rows.join(named, rows["source"].eqNullSafe(named["_source"])).drop("_source")
    whole = F.floor("_ratio")
    split = known.withColumn("_copies", whole).withColumn("_fraction", F.col("_ratio") - whole)
    keys = ["source", "source_size", "target", "_no", "_copies"]
    fractional = (F.col("_fraction") > 0) & (F.col("size") > 0)
    results = [split.where(~fractional).select("doc_id", "size", *keys)]

    order = [F.col("_no"), F.col("size").desc(), F.col("doc_id").asc_nulls_first()]
    ranked = with_index(split.where(fractional), order, "_rank")
    items = ranked.select(
        *keys, F.col("_rank").alias("rank"), F.col("size").alias("w"), (F.col("size") * F.col("_fraction")).alias("a"), "doc_id"
    )
    total = rows.count()
    levels = max(1, -(-max(total - 1, 1).bit_length() // BLOCK_BITS))
    for level in range(1, levels + 1):
        block = F.shiftright("rank", level * BLOCK_BITS).alias("_block")
        if level == levels:  # one block per source
            block = F.lit(0).alias("_block")
        # folding costs far more than its few bytes tell, so tasks are dealt by rows
        tasks = max(1, min(MOST_TASKS, (total >> (level - 1) * BLOCK_BITS) // TASK_ROWS))
        dealt = items.withColumn("_block", block).repartition(tasks, "_no", "_block")
        listed = dealt.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct("rank", "w", "a", "doc_id"))).alias("_items"))
        folded = staged(listed.select(*keys, _round_best(F.col("_items"), doc_type, seed, tries).alias("_s")))
        out = folded.select(*keys, F.explode("_s.done").alias("_d"))
        results.append(out.select("_d.doc_id", F.col("_d.w").alias("size"), *keys[:-1], (F.col("_copies") + F.col("_d.up")).alias("_copies")))
        items = folded.where("_s.carried.w > 0").select(*keys, "_s.carried.*")
    last = (F.col("a") * 2 >= F.col("w")).cast("int")
    results.append(items.select("doc_id", F.col("w").alias("size"), *keys[:-1], (F.col("_copies") + last).alias("_copies")))
    return reduce(DataFrame.unionByName, results).select(
        "doc_id", "source", "size", "source_size", "target", F.col("_copies").cast("bigint").alias("copies"),
        (F.col("_copies") * F.col("size")).cast("bigint").alias("taken"),
    )


def _level_sql(level: int, seed: int) -> str:
    """One level of the tree: documents meet one after another within their block, in several tries."""
    block = f"if({level} < (select root from tree), rank >> {BLOCK_BITS * level}, 0)"
    return f"""
n{level} as (
  select *, {block} as block, row_number() over (partition by no, {block} order by rank) as pos, count(*) over (partition by no, {block}) as n
  from i{level - 1}
),
t{level} as (select n.*, attempt, '{seed}:' || attempt || ':' as salt from n{level} n, range({TRIES}) r(attempt)),
f{level} as (
  select no, block, attempt, pos, n, rank, w, a, doc_id, null::bigint as out_w, null::bigint as out_id, null::int as up, false as whole from t{level} where pos = 1
  union all
  select no, block, attempt, pos, n, if(stays, c_rank, x_rank), if(stays, c_w, x_w), mass, if(stays, c_id, x_id),
    if(alone, null, if(stays, x_w, c_w)), if(alone, null, if(stays, x_id, c_id)), up, not alone and (mass <= 0 or mass >= if(stays, c_w, x_w))
  from (
    select *, if(alone, false, if(upwards, c_w - c_a > x_a, c_a > x_w - x_a)) as stays,
      case when alone then x_a when upwards then if(c_w - c_a <= x_a, x_a - (c_w - c_a), c_a + x_a) else if(c_a <= x_w - x_a, x_a + c_a, c_a - (x_w - x_a)) end as mass,
      case when alone then null when upwards then if(c_w - c_a <= x_a, 1, 0) else if(c_a <= x_w - x_a, 0, 1) end as up
    from (
      select x.no, x.block, x.attempt, x.pos, x.n, c.whole as alone, c.rank as c_rank, c.w as c_w, c.a as c_a, c.doc_id as c_id,
        x.rank as x_rank, x.w as x_w, x.a as x_a, x.doc_id as x_id,
        cast('0x' || substr(md5(x.salt || c.rank || ':' || x.rank), 1, 12) as bigint) / 281474976710656.0
          * (least(c.w - c.a, x.a) + least(c.a, x.w - x.a)) < least(c.a, x.w - x.a) as upwards
      from f{level} c join t{level} x on x.no = c.no and x.block = c.block and x.attempt = c.attempt and x.pos = c.pos + 1
    )
  )
),
b{level} as (
  select no, block, attempt from f{level} where pos = n
  qualify row_number() over (partition by no, block order by if(whole, 0, least(a, w - a)), attempt) = 1
),
g{level} as (select f.* from f{level} f join b{level} using (no, block, attempt)),
d{level} as (
  select no, out_id as doc_id, out_w as size, up from g{level} where up is not null
  union all select no, doc_id, w, if(a > 0, 1, 0) from g{level} where whole
),
i{level} as (select no, rank, w, a, doc_id from g{level} where not whole and pos = n)"""


def mixing_sql(levels: int = 5, seed: int = SEED) -> str:
    """The same mix in SQL, for tables of up to 64 ** `levels` documents and whole-number ids."""
    parts = ",".join(_level_sql(level, seed) for level in range(1, levels + 1))
    decided = " union all ".join(f"select * from d{level}" for level in range(1, levels + 1))
    return rf"""
with recursive docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
),
tree as (select greatest(1, ceil(length(ltrim(bin(greatest(count(*) - 1, 1)), '0')) / {BLOCK_BITS}.0))::int as root from docs),
sources as (
  select *, row_number() over (order by source nulls last) - 1 as no from (select source, sum(size)::bigint as source_size from docs group by source)
),
weighed as (select *, [3.0::double, 1.0, 2.0][1 + no % 3] as w, source_size * 2 as cap from sources),
shares as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over below, 0)) / (sum(w) over () - coalesce(sum(w) over below, 0)) as level
  from weighed window below as (order by cap / w, no rows between unbounded preceding and 1 preceding)
),
water as (select coalesce(max(level) filter (where cap >= level * w), 0) as level from shares),
targets as (
  select source, no, source_size, if(cap < (select level from water) * w, cap::double, (select level from water) * w) as target from weighed
),
known as (
  select d.*, t.no, t.source_size, t.target, if(t.source_size > 0, t.target / t.source_size, 0) as ratio
  from docs d join targets t on d.source is not distinct from t.source
),
parted as (select *, floor(ratio)::bigint as copies, ratio - floor(ratio) as part from known),
i0 as (
  select no, row_number() over (order by no, size desc, doc_id nulls first) - 1 as rank, size as w, size * part as a, doc_id
  from parted where part > 0 and size > 0
),{parts},
decided as (
  {decided}
  union all select no, doc_id, w, if(a * 2 >= w, 1, 0) from i{levels}
),
copied as (
  select doc_id, size, no, copies from parted where not (part > 0 and size > 0)
  union all select d.doc_id, d.size, d.no, floor(t.target / t.source_size)::bigint + d.up from decided d join targets t using (no)
)
select c.doc_id, c.size, t.source_size, t.target, (c.copies * c.size)::bigint as taken from copied c join targets t using (no)
"""
