"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Documents of a source have merits, by default by their length. The number of copies a document should get on average is
in proportion to its merit, but at most two; what this cuts off is shared by the others again, until the source's target is
met. The whole part is given to every document. For the rest documents are ranked by their random odds over their inclusion odds, and the
first of them are taken as long as the words stay within the target; what is then missing is made up by the one
document that comes nearest to it among those next in rank. Ranks are never computed for a whole source: words are
summed by stretches of the rank value, and only the one stretch in which the target lies is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textgrade.llm.common import WORD, broadcast_if_small, same
from textgrade.operators.ranks import running_totals
from textgrade.sources.settled import settle

WEIGHTS = (5, 2, 1)
#: By default a document's merit is 1, and one more for each so many words, up to the last number.
MERIT_WORDS, MERIT_MOST = 200, 4
#: Documents that a stretch of the rank value holds on average.
STRETCH = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _merit(size: Column, merit_col: str | None) -> Column:
    """Whole numbers by length, or what a column says; null and less than 0 count as 0."""
    if merit_col is None:
        return F.least(F.floor(size / MERIT_WORDS) + 1, F.lit(MERIT_MOST)).cast("long")
    return F.greatest(F.coalesce(F.col(merit_col).cast("double"), F.lit(0.0)), F.lit(0.0))


def _ratios(sized: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``name``, ``source_size``, ``target`` and ``ratio``, the copies for a merit of 1, of each source.

    Documents in order of falling merit reach ``most`` one merit after the other; the ratio that shares the rest of the target
    by merit is the greatest at which the next merit does not. Only distinct merits are put in order.
    """
    cells = sized.where("merit > 0").groupBy("source", "merit").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("merit")).alias("mass")
    )
    cells = cells.withColumn("falling", -F.col("merit"))
    steps = running_totals(cells, ["source"], ["falling"], ["words", "mass"], STRETCH)
    steps = steps.join(broadcast_if_small(targets), same(F.col("source"), F.col("name")))
    ratio = F.try_divide(
        F.col("target") - F.lit(float(most)) * F.col("before_words"), (F.col("all_mass") - F.col("before_mass")).cast("double")
    )
    found = steps.withColumn("ratio", ratio).groupBy("name").agg(
        F.max(F.when(F.col("ratio") * F.col("merit") <= most, F.col("ratio"))).alias("ratio"), F.min("merit").alias("least")
    )
    found = found.select(F.col("name").alias("of"), F.coalesce("ratio", F.lit(float(most)) / F.col("least")).alias("ratio"))
    met = targets.join(found, same(F.col("name"), F.col("of")), "left")
    return met.select("name", "source_size", "target", F.when(F.col("target") > 0, F.col("ratio")).alias("ratio")).fillna(0.0, ["ratio"])


def water_fill(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of every row ``(source, source_size)``.

    Sources in code point order, null last, get the weights in turn. The targets add up to ``share`` times all sizes;
    one stops at ``most`` times its source's size and what is too much goes to the others by weight. The level that
    the others share is found in one pass over the sources in order of the level at which each stops. This table is
    the only thing put in one order: a narrow row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(int(w)) for w in weights])
    rows = sizes.withColumn(
        "weight", F.element_at(turn, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("stop", F.col("source_size") * most)
    level = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spare = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    rows = rows.withColumn("level", spare / F.sum("weight").over(after))
    reached = F.col("level") <= F.col("stop") / F.col("weight")
    rows = rows.withColumn("shared", F.max(F.when(reached, F.col("level"))).over(everything))
    stopped = F.col("shared").isNull() | (F.col("stop") < F.col("shared") * F.col("weight"))
    return rows.select(
        "source",
        "source_size",
        F.when(stopped, F.col("stop").cast("double")).otherwise(F.col("shared") * F.col("weight")).alias("target"),
    )


def _ranked(rows: DataFrame, seed: int, most: int) -> DataFrame:
    """``rows`` (id, source, size, merit, ratio) with whole copies and, where a part is left, the rank value."""
    mean = F.col("ratio") * F.col("merit")
    rows = rows.withColumn("mean", F.least(F.coalesce(mean, F.lit(0.0)), F.lit(float(most))))
    rows = rows.withColumn("whole", F.floor("mean")).withColumn("part", F.col("mean") - F.col("whole"))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "source", "size")]
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))
    number = F.conv(F.substring(draw, 1, 13), 16, 10).cast("long")
    u = (number + F.lit(0.5)) / F.lit(float(2**52))
    value = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    return rows.withColumn("draw", draw).withColumn("value", F.when(F.col("part") > 0, value))


def _stretch(count: int) -> Column:
    stretches = float(max(1, -(-count // STRETCH)))
    return F.floor(F.col("value") / (1 + F.col("value")) * F.lit(stretches)).cast("long")


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    merit_col: str | None = None,
    seed: int = 9,
) -> tuple[DataFrame, DataFrame, int]:
    """Sized rows, the cut of each source, and the number of rows: what :func:`copies_of` decides by.

    Merits make the inclusion odds of a source's documents unequal: by length, or those of ``merit_col``, where a null counts
    as 0 and a document of merit 0 is never taken; the others then make up for it as far as they can.
    """
    size = n_words(F.col(text_col))
    sized = settle(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), _merit(size, merit_col).alias("merit"))
    )
    count = sized.count()
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(water_fill(sums, weights, share, most).withColumnRenamed("source", "name"))
    sources = settle(_ratios(sized, targets, most))
    known = broadcast_if_small(sources)
    ranked = _ranked(sized.join(known, same(F.col("source"), F.col("name"))), seed, most)
    ranked = ranked.withColumn("stretch", _stretch(count))

    sums = settle(
        ranked.groupBy("name", "stretch").agg(
            F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.max("target").alias("target")
        )
    )
    certain = sums.groupBy("name").agg((F.max("target") - F.sum("certain")).alias("goal"))
    ordered = Window.partitionBy("name").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    steps = sums.where("stretch is not null").withColumn("before", F.coalesce(F.sum("words").over(ordered), F.lit(0)))
    goals = certain.withColumnRenamed("name", "of")
    steps = steps.join(goals, same(F.col("name"), F.col("of"))).where(F.col("before") <= F.col("goal"))
    last = settle(
        steps.groupBy("name")
        .agg(F.max(F.struct("stretch", "before", "goal")).alias("at"))
        .select(F.col("name").alias("of"), F.col("at.stretch").alias("last"), "at.before", "at.goal")
    )
    edge = ranked.join(broadcast_if_small(last), same(F.col("name"), F.col("of")) & (F.col("stretch") == F.col("last")))
    order = Window.partitionBy("of").orderBy("value", "draw").rowsBetween(Window.unboundedPreceding, 0)
    edge = settle(
        edge.select("of", "goal", "before", "size", F.struct("value", "draw").alias("key"), F.sum("size").over(order).alias("run"))
    )
    inside = (F.col("before") + F.col("run")) <= F.col("goal")
    cuts = edge.groupBy("of").agg(
        F.max(F.when(inside, F.col("key"))).alias("cut"),
        (F.max("goal") - F.max("before") - F.coalesce(F.max(F.when(inside, F.col("run"))), F.lit(0))).alias("gap"),
    )
    off = F.abs(F.col("gap") - F.col("size"))
    more = (
        edge.where(~inside)
        .join(cuts.select(F.col("of").alias("o"), "gap"), same(F.col("of"), F.col("o")))
        .where(off < F.col("gap"))
        .groupBy(F.col("of").alias("more_of"))
        .agg(F.min(F.struct(off.alias("off"), "key")).getField("key").alias("more"))
    )
    cuts = cuts.join(more, same(F.col("of"), F.col("more_of")), "left").select(F.col("of").alias("cut_of"), "cut", "more")
    cuts = last.join(cuts, same(F.col("of"), F.col("cut_of"))).select("of", "last", "cut", "more")
    plan = sources.join(cuts, same(F.col("name"), F.col("of")), "left").drop("of")
    return sized, settle(plan), count


def _copies(rows: DataFrame, plan: DataFrame, count: int, seed: int, most: int) -> DataFrame:
    """``rows`` (id, source, size, merit and any others) with their source's figures and ``copies``."""
    ranked = _ranked(rows.join(broadcast_if_small(plan), same(F.col("source"), F.col("name"))), seed, most)
    stretch, key = _stretch(count), F.struct("value", "draw")
    drawn = (stretch < F.col("last")) | ((stretch == F.col("last")) & ((key <= F.col("cut")) | (key == F.col("more"))))
    extra = F.when(F.col("value").isNotNull() & drawn, 1).otherwise(0)  # a missing cut or filler counts as false
    return ranked.withColumn("copies", (F.col("whole") + extra).cast("long"))


def mix_sources(docs: DataFrame, most: int = 2, seed: int = 9, **how) -> DataFrame:
    """Per row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    Sizes are words; a null text has none. Null is a source of its own. Rows alike in id, source and size are taken
    alike; rows without words are copied like others but take nothing. A source without words has the target 0. An
    empty table gives an empty result; other columns are ignored. The same rows get the same copies in every run.
    """
    sized, plan, count = plan_mix(docs, most=most, seed=seed, **how)
    return _copies(sized, plan, count, seed, most).select(
        F.col("id").alias("doc_id"),
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    most: int = 2,
    seed: int = 9,
    **how,
) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it. Texts are not shuffled."""
    merit_col = how.get("merit_col")
    _, plan, count = plan_mix(docs, id_col, text_col, source_col, most=most, seed=seed, **how)
    size = n_words(F.col(text_col))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        row.alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        _merit(size, merit_col).alias("merit"),
    )
    taken = _copies(rows, plan, count, seed, most).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


#: The same in DuckDB, for the default settings.
MIX_SQL = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from {docs}
), d as (
  select *, least(size // 200 + 1, 4)::bigint as merit from sized
), s as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as weight
  from d group by source
), l as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(source_size * 2) over (
      order by source_size * 2 / weight::double, source asc nulls last rows between unbounded preceding and 1 preceding), 0)::double)
    / sum(weight) over (
      order by source_size * 2 / weight::double, source asc nulls last rows between current row and unbounded following)::double as level
  from s
), m as (
  select *, max(case when level <= source_size * 2 / weight::double then level end) over () as shared from l
), t as (
  select source, source_size, case when shared is null or source_size * 2 < shared * weight then (source_size * 2)::double
    else shared * weight end as target from m
), c as (
  select source, merit, sum(size)::double as words, sum(size * merit)::double as mass from d group by source, merit
), k as (
  select c.source, merit, (target - 2.0::double * coalesce(sum(words) over before, 0))
      / nullif(sum(mass) over (partition by c.source) - coalesce(sum(mass) over before, 0), 0) as ratio
  from c join t on c.source is not distinct from t.source
  window before as (partition by c.source order by merit desc rows between unbounded preceding and 1 preceding)
), q as (
  select source, coalesce(max(case when ratio * merit <= 2 then ratio end), 2.0::double / min(merit)) as ratio from k group by source
), r as (
  select d.doc_id, d.source, d.size, t.source_size, t.target,
    least(case when t.target = 0 then 0 else q.ratio * d.merit end, 2.0::double) as mean,
    md5('9:' || coalesce(d.doc_id::varchar, '') || ':' || coalesce(d.source, '') || ':' || d.size::varchar) as draw
  from d join t on d.source is not distinct from t.source join q on d.source is not distinct from q.source
), v as (
  select *, floor(mean)::bigint as whole, mean - floor(mean) as part,
    (('0x' || substr(draw, 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u from r
), w as (
  select *, case when part > 0 then (u / (1 - u)) / (part / (1 - part)) end as value,
    target - sum(whole * size) over (partition by source)::double as goal from v
), x as (
  select *, sum(size) over (partition by source, value is null order by value, draw)::double as run,
    floor(value / (1 + value) * ceil(greatest((select count(*) from d), 1) / 4096.0::double)) as stretch from w
), y as (
  select *, max(case when value is not null and run - size <= goal then stretch end) over (partition by source) as last,
    goal - coalesce(max(case when value is not null and run <= goal then run end) over (partition by source), 0) as gap
  from x
), z as (
  select *, value is not null and stretch <= last and run <= goal as inside,
    value is not null and stretch = last and run > goal and abs(gap - size) < gap as spare from y
), n as (
  select *, row_number() over (partition by source, spare order by abs(gap - size), value, draw) = 1 and spare as more from z
)
select doc_id, size, source_size, target,
  (whole + case when inside or more then 1 else 0 end) * size as taken from n
"""
