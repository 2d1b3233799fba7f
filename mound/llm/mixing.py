"""Mixing sources to target weights by repetition rates.

Words are summed per source, shares become targets by filling up to a limit of
``MOST`` times a source's words, and every document is emitted ``floor(rate)`` times plus
once more if a hash of its id (of its text where it has none), as a fraction, is below the rest of the rate. The
documents themselves are never shuffled: the table of rates (a row a source) is settled and
joined by the size Spark measures, and adaptive execution splits a hot source if it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mound.llm.tables import WORD, settle, text_of

SEED = 7
CYCLE = (5, 2, 1)
MOST = 3


def words(text: str = "text") -> Column:
    """Words of a text; none for a null one."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def draw(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A fraction from 0 to 1 fixed by the document's id, or by its text where the id is null."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("none:"), F.md5(text_of(text).cast("binary"))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(16**13))


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` from ``source`` and ``size`` rows.

    Sources in code point order, null last, weigh ``cycle``, repeating, and share the words of all.
    What a source gets beyond ``most`` times its words goes to the others by weight:
    in the order of size over weight the sources below the final level are full, so the
    level is the first whose next source is not. A source without words gets none.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    first = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.row_number().over(first) - 1, F.lit(len(cycle))) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    left = F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy())
    share = (whole - full).cast("double") / left.cast("double")
    per = per.withColumn("level", share).withColumn("open", F.col("source_size") * most >= share * F.col("weight"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.col("weight") * final, (F.col("source_size") * most).cast("double"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def rated(docs: DataFrame, seed: int = SEED, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """All documents with ``size``, ``source_size``, ``target`` and ``copies``.

    Empty and null texts have size 0; they are emitted by their source's rate like others, and a source that has only
    such texts has rate 0. Columns of these names are replaced. Equal rows draw alike.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    rates = settle(targets(docs.select("source", words().alias("size")), cycle, most))
    rates = rates.select(F.struct("source").alias("of"), "source_size", "target")
    rows = docs.select(F.struct("*").alias("d"), F.struct("source").alias("of"), words().alias("size"), draw(seed).alias("u"))
    rows = rows.join(rates, "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (F.col("u") < rate - F.floor(rate)).cast("long")
    return rows.select(*[F.col(f"d.`{c}`") for c in kept], "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, seed: int = SEED, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """The mixture: every document ``copies`` times, with the columns it had, those of clashing names too.

    Documents with a rate of 0 (of sources without words) are gone; an empty table stays empty. Draws are independent, so a
    source's words miss its target by about the root of the sum of ``size ** 2 * f * (1 - f)`` over its documents, f
    being the fraction of the rate.
    """
    rows = rated(docs.select("doc_id", "source", "text", F.struct("*").alias("d")), seed, cycle, most)
    each = rows.select("d", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return each.select("d.*")


# DuckDB: the same rule over the whole table.
ORACLE = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'none:' || md5(coalesce(text, '')))), 1, 13))::bigint)::double / {float(16**13)!r} as u
  from documents),
per as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from d group by source),
lev as (
  select *, ((sum(source_size) over ())
      - {MOST} * coalesce(sum(source_size) over (order by source_size / weight, source nulls last
          rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by source_size / weight, source nulls last
          rows between current row and unbounded following))::double as level
  from per),
fin as (
  select arg_min(level, source_size / weight) filter (where source_size * {MOST} >= level * weight) as level from lev),
rates as (
  select source, source_size, coalesce(least(weight * fin.level, (source_size * {MOST})::double), 0.0) as target
  from lev, fin),
joined as (
  select d.*, r.source_size, r.target, case when source_size > 0 then target / source_size else 0.0 end as rate
  from d join rates r on d.source is not distinct from r.source)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from joined
"""
