"""Mix sources to target weights: pivotal rounding of copy counts over a reduction tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormgrid.llm.common import count_words, materialize, table

#: Most copies of a document, most mass of a source, and rows that one fold takes on average.
MOST = 3
FAN = 64
REPEATS = 1024  # equal rows that one task numbers

# Two open units a and b share mass: raising a by x lowers b by x * a.size / b.size, so the words
# taken stay the same. up and down are the largest moves either way; one of them is drawn with the
# odds that leave both expectations unchanged, and it makes a or b whole (0 or 1).
_FOLD = """
aggregate(
  units,
  cast(struct(null as open, array() as closed) as struct<open: {unit}, closed: array<{unit}>>),
  (acc, x) -> case when acc.open is null then named_struct('open', x, 'closed', acc.closed) else
    transform(array(named_struct('a', acc.open, 'b', x,
      'up', least(1 - acc.open.p, x.p * x.size / acc.open.size),
      'down', least(acc.open.p, (1 - x.p) * x.size / acc.open.size),
      'u', pmod(xxhash64(acc.open.doc_id, acc.open.size, acc.open.nth, x.doc_id, x.size, x.nth, {seed}), 1073741824) / 1073741824D)),
    m -> transform(array(case when m.u * (m.up + m.down) < m.down then named_struct(
        'pa', case when m.a.p + m.up > 1 - 1e-12 then 1D else m.a.p + m.up end,
        'pb', case when m.b.p - m.up * m.a.size / m.b.size < 1e-12 then 0D
              else m.b.p - m.up * m.a.size / m.b.size end)
      else named_struct(
        'pa', case when m.a.p - m.down < 1e-12 then 0D else m.a.p - m.down end,
        'pb', case when m.b.p + m.down * m.a.size / m.b.size > 1 - 1e-12 then 1D
              else m.b.p + m.down * m.a.size / m.b.size end) end),
      q -> transform(array(named_struct(
          'a', named_struct('doc_id', m.a.doc_id, 'size', m.a.size, 'nth', m.a.nth, 'whole', m.a.whole, 'p', q.pa),
          'b', named_struct('doc_id', m.b.doc_id, 'size', m.b.size, 'nth', m.b.nth, 'whole', m.b.whole, 'p', q.pb))),
        r -> case
          when r.a.p in (0D, 1D) and r.b.p in (0D, 1D) then named_struct(
            'open', cast(null as {unit}), 'closed', concat(acc.closed, array(r.a, r.b)))
          when r.a.p in (0D, 1D) then named_struct(
            'open', r.b, 'closed', array_append(acc.closed, r.a))
          else named_struct('open', r.a, 'closed', array_append(acc.closed, r.b)) end)[0])[0])[0]
  end)
"""
_UNIT = "struct<doc_id: bigint, size: bigint, nth: bigint, whole: int, p: double>"


def source_targets(sized: DataFrame) -> DataFrame:
    """Sizes, counts and targets of the sources (columns source, source_size, n, target).

    Sources in code point order, null last, weigh 1, 2, 3, repeating. A target stops at ``MOST``
    times its source's size and the rest is shared again by weight. Sorted by that stop over the
    weight, the stopped sources are a prefix, so one level for all others follows from sums.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("most", (MOST * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        weighed.withColumn("stopped", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("all", F.sum("source_size").over(total))
        .withColumn("level", (F.col("all") - F.col("stopped")) / F.sum("weight").over(after))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
        .withColumn("rank", F.row_number().over(order))
    )
    first = F.min(F.when(F.col("fits"), F.struct("rank", "level"))).over(total)["level"]
    return level.select(
        "source",
        "source_size",
        "n",
        F.least(F.col("most"), F.coalesce(first, F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def _folded(units: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """One fold for each group: its open unit, and the units that it made whole."""
    grouped = units.groupBy(*keys).agg(F.sort_array(F.collect_list("unit")).alias("units"))
    fold = F.expr(_FOLD.format(unit=_UNIT, seed=f"{seed}L"))
    return grouped.withColumn("fold", fold).select(*keys, "fold.open", "fold.closed")


def _numbered(rows: DataFrame) -> DataFrame:
    """Each row with nth, its number among equal rows.

    Equal rows are counted, and counts are unfolded to rows; large ones in parts that are dealt anew.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("repeats"))
    few = counted.where(F.col("repeats") <= REPEATS).withColumn("nth", F.explode(F.expr("sequence(0L, repeats - 1)")))
    parts = counted.where(F.col("repeats") > REPEATS).withColumn("start", F.explode(F.expr(f"sequence(0L, repeats - 1, {REPEATS}L)")))
    parts = parts.repartition("doc_id", "size", "start")
    many = parts.withColumn("nth", F.explode(F.expr(f"sequence(start, least(start + {REPEATS}, repeats) - 1)"))).drop("start")
    return few.unionByName(many).drop("repeats")


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """Draw how often each document is taken, so that sources come near their targets.

    A document's expected copies are its source's target over the source's size. The whole part is
    sure. The fraction is rounded by dependent pivotal sampling: in groups of about ``FAN`` rows,
    units pass mass in words to each other until all but one are whole, and the units left over
    meet in groups of the next level, up to one for each source. So a source misses its target by
    less than one document, however large it is. Draws hash the ids of both units: reruns agree.

    Returns doc_id, size, source_size, target, copies (0 to 3), taken. Null and blank texts have
    size 0 and are never taken; a null source is a source; repeated rows are numbered and drawn one by
    one, however many there are, so no chunk holds more than a few times ``FAN`` of them; an empty table gives no rows. Other columns are not read. doc_id may be null but must be integral.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        count_words(F.col("text")).alias("size"),
    )
    # Narrow rows, used for the sums and for the draw: the texts are counted once.
    sized = materialize(sized, "mixing-sizes")
    targets = source_targets(sized).withColumnRenamed("source", "of")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["of"])).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.ceil(F.col("n") / FAN).cast("long").alias("chunks"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(0.0)
        .alias("rate"),
    )
    whole = F.floor(F.col("rate") + 1e-12).cast("int")
    share = F.greatest(F.col("rate") - whole, F.lit(0.0))
    rows = rows.withColumn("whole", whole).withColumn("p", share)
    sure = (F.col("p") < 1e-12) | (F.col("size") == 0)
    keep = ["source", "source_size", "target"]
    units = _numbered(rows.where(~sure).drop("rate")).select(
        *keep,
        F.pmod(F.xxhash64("doc_id", "size", "nth"), F.col("chunks")).alias("chunk"),
        F.struct("doc_id", "size", "nth", "whole", "p").alias("unit"),
    )
    level = materialize(_folded(units, [*keep, "chunk"], seed), "mixing-0")
    most = level.agg(F.max("chunk")).first()[0] or 0
    closed = [level]
    depth = 0
    while most > 0:
        depth, most = depth + 1, most // FAN
        units = level.where("open is not null").select(
            *keep,
            F.floor(F.col("chunk") / FAN).cast("long").alias("chunk"),
            F.col("open").alias("unit"),
        )
        level = materialize(_folded(units, [*keep, "chunk"], seed + depth), f"mixing-{depth}")
        closed.append(level)
    u = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    parts = [
        x.select(*keep, F.explode("closed").alias("unit"))
        .select(*keep, "unit.*")
        .withColumn("copies", F.col("whole") + F.col("p").cast("int"))
        for x in closed
    ]
    last = level.where("open is not null").select(*keep, "open.*")
    parts.append(last.withColumn("copies", F.col("whole") + (u < F.col("p")).cast("int")))
    parts.append(
        rows.where(sure).withColumn("copies", F.when(F.col("size") > 0, F.col("whole")).otherwise(0))
    )
    columns = ["doc_id", "size", "source_size", "target", "copies"]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionAll(part.select(*columns))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )
