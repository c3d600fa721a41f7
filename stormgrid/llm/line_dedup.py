"""Line dedup by a log-template tree: leaves of token count and leading tokens, generalised fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.llm.common import fresh_names, marked, marks, materialize, sliced, small_batches, spread_join, table

DEPTH = 3  # leading tokens of a leaf
LEAST_BYTES = 20  # shorter lines are never dropped
LEAST_DOCUMENTS = 2  # in which a template recurs
ALIKE = 7  # tenths of a line's other tokens that its template fixes, at least

_BLANK = r" \t\x0B\f\r"
_KEY = ["leaf", "n"]
_DIGIT = re.compile(rb"[0-9]")
_FIELD = re.compile(rb"[^ \t\x0B\f\r0-9]*[0-9][^ \t\x0B\f\r]*")


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def masked(line: bytes) -> list[bytes]:
    """The tokens of a line; those with a digit are variable fields."""
    return (_FIELD.sub(b"<*>", line) if _DIGIT.search(line) else line).split()


def fixed_size(n):
    """How many tokens behind the leading ones a template of n tokens fixes: ALIKE tenths, rounded up."""
    return (ALIKE * (n - DEPTH) + 9) // 10


def _texts(docs: DataFrame) -> DataFrame:
    """row tells texts of one id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at, n, leaf, line) of every line of LEAST_BYTES: token count, hash of its leading tokens, hash of all."""
    names = ["at", "n", "leaf", "line"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row bigint, at int, n int, leaf bigint, line bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, values = [], ([], [], [], [])
            for k, text in enumerate(batch.column("text").to_pylist()):
                if text is None:
                    continue
                for at, line in enumerate(text.encode().split(b"\n")):
                    tokens = masked(line)
                    whole = b"\0".join(tokens)
                    if len(whole) < LEAST_BYTES:
                        continue
                    who.append(k)
                    row = (at, len(tokens), _hash(b"\0".join(tokens[:DEPTH])), _hash(whole))
                    for column, value in zip(values, row, strict=True):
                        column.append(value)
            of = batch.select(["doc_id", "row"]).take(pa.array(who, pa.int64()))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            columns = [*of.columns, *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))]
            yield from sliced(pa.RecordBatch.from_arrays(columns, ["doc_id", "row", *names]))

    return _texts(docs).mapInArrow(run, schema)


def _cells(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """(line, cells) of the lines of ``shown``, and of few others: hashes of leaf, place and token behind the leading ones.

    A bitmap tells which lines are needed, so that only they leave their task.
    """
    flags = marks(shown, "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, needed = 8 * len(flags.value) - 1, flags.value
        for batch in batches:
            found: dict[int, list[int]] = {}
            for text in batch.column("text").to_pylist():
                for line in () if text is None else text.encode().split(b"\n"):
                    tokens = masked(line)
                    if len(tokens) <= DEPTH + 1:
                        continue
                    name = _hash(b"\0".join(tokens))
                    bit = name & bits
                    if needed[bit >> 3] >> (bit & 7) & 1 and name not in found:
                        leaf = b"\0".join([b"%d" % len(tokens), *tokens[:DEPTH]])
                        found[name] = [_hash(b"%s\0%d\0%s" % (leaf, k, t)) for k, t in enumerate(tokens[DEPTH:])]
            columns = [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))]
            yield from sliced(pa.RecordBatch.from_arrays(columns, ["line", "cells"]))

    return docs.select("text").mapInArrow(run, "line bigint, cells array<bigint>")


def _templates(docs: DataFrame, distinct: DataFrame, least_documents: int) -> DataFrame:
    """(leaf, n, line, template) of the lines that share their template with another line.

    Of a line's tokens behind the leading ones, those that the most distinct lines of its leaf hold in
    the same place are fixed, ``fixed_size`` of them, and the others variable. Leaves with too few
    lines to recur are left out: none of their lines can be dropped by a template.
    """
    leaves = distinct.where(F.col("n") > DEPTH + 1).groupBy(*_KEY).agg(F.count("*").alias("lines"), F.sum("times").alias("times"))
    leaves = leaves.where((F.col("lines") > 1) & (F.col("times") >= least_documents)).select(*_KEY)
    shown = materialize(distinct.join(leaves, _KEY).select(*_KEY, "line"), "lines-shown")
    cells = _cells(docs, shown).dropDuplicates(["line"]).join(shown.select("line"), "line", "left_semi")
    cells = materialize(cells, "line-cells").select("line", F.posexplode("cells").alias("place", "cell"))
    often = materialize(cells.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1"), "cells-often")
    held = spread_join(cells, often, ["cell"], "left", counts=often).groupBy("line").agg(
        F.sort_array(F.collect_list(F.struct((-F.coalesce("c", F.lit(1))).alias("c"), "place", "cell"))).alias("held")
    )
    fixed = F.transform(F.slice("held", 1, F.expr(f"cast(({ALIKE} * size(held) + 9) div 10 as int)")), lambda x: x["cell"])
    named = held.select("line", F.xxhash64(F.array_sort(fixed)).alias("template"))
    named = materialize(shown.join(named, "line"), "lines-templates")
    several = named.groupBy(*_KEY, "template").agg(F.count("*").alias("c")).where("c > 1")
    return named.join(several.drop("c"), [*_KEY, "template"]).select(*_KEY, "line", "template")


def _touched(docs: DataFrame, gone: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """Documents that may lose lines, and the others, which then need no shuffle."""
    flags = marks(gone, "gone_row")

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = marked(flags.value, batch.column(row).to_numpy())
                yield batch.filter(pa.array(own == wanted, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    return part(True), part(False)


def dedup(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Drop lines whose template recurs in ``least_documents`` documents, except its first line.

    Lines are split at newlines and blanks; tokens with digits are variable. The tree has two
    levels: token count, and the ``DEPTH`` leading tokens. A leaf holds any number of templates: a
    line's template keeps, of its tokens behind the leading ones, the seven tenths that are the most
    frequent in their places among the distinct lines of the leaf (earlier places first), and the
    others are variable fields. All lines of one template see the same frequencies, so neither other
    templates nor prose in the leaf part them, unless a field's value is more frequent than the
    template's own words. A line that shares its template with no other line is its own template.
    The first line of a template by doc_id and place stays, so no passage is lost. Lines of fewer
    than ``LEAST_BYTES`` bytes (tokens with single blanks) stay.

    Distinct lines are counted before leaves are formed, so a common line is one row there, and
    all counts are distributed sums. Lines, templates and documents are compared by 64-bit hashes.

    Returns the columns of ``docs`` with the new text, and n_lines and n_dropped (replaced if
    there); other columns may have any name without a dot. Null texts stay null with 0 lines; empty ones have one
    line; rows with equal id and text count as one document and change alike; null ids come first.
    Needs doc_id and text.
    """
    long = materialize(_lines(docs), "lines")
    distinct = long.groupBy(*_KEY, "line").agg(F.count("*").alias("times"))
    distinct = materialize(distinct, "lines-distinct")
    covered = _templates(docs, distinct, least_documents)
    named = spread_join(long, covered, [*_KEY, "line"], "left", counts=distinct.withColumnRenamed("times", "c")).withColumns(
        {"line": F.coalesce("template", "line"), "general": F.col("template").isNotNull()}
    )
    template = [*_KEY, "line", "general"]
    named = materialize(named.select("doc_id", "row", "at", *template), "lines-named")
    once = named.groupBy(*template, "doc_id", "row").agg(F.min("at").alias("at"), F.count("*").alias("lines"))
    recurring = once.groupBy(*template).agg(
        F.count("*").alias("documents"), F.sum("lines").alias("lines"), F.min(F.struct("doc_id", "row", "at")).alias("first")
    )
    # A template of many lines is told also where it does not recur, so that its lines spread.
    recurring = recurring.where((F.col("documents") >= least_documents) | (F.col("lines") > 1000))
    recurring = materialize(recurring, "lines-recurring")
    again = recurring.where(F.col("documents") >= least_documents).select(*template, "first")
    gone = spread_join(named, again, template, counts=recurring.withColumnRenamed("lines", "c")).where(~F.struct("doc_id", "row", "at").eqNullSafe(F.col("first")))
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("at").alias("gone_at"))
    row, gone_id, gone_row, gone_at = fresh_names(docs, "row", "gone_id", "gone_row", "gone_at")
    gone = materialize(gone.select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "gone_at"), "lines-gone")

    keep = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    touched, others = _touched(docs.select(*keep, "text", F.xxhash64("text").alias(row)), gone, row)
    joined = touched.join(
        gone.toDF(gone_id, gone_row, gone_at),
        F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(row) == F.col(gone_row)),
        "left",
    )
    # The struct is one value inside, so that a text is split once.
    left = F.expr(f"""
        transform(array(named_struct('lines', split(text, '\n'), 'gone', {gone_at})), x -> array_join(
          transform(array_except(sequence(0, size(x.lines) - 1), x.gone), i -> get(x.lines, i)), '\n'))[0]""")
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines")
    changed = joined.select(
        *keep,
        F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(left).alias("text"),
        n_lines,
        F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return changed.unionAll(others.select(*keep, "text", n_lines, F.lit(0).cast("long").alias("n_dropped")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", "text")


SQL = rf"""
with cut as (
  select doc_id, unnest(range(len(l))) as pos, unnest(l) as raw
  from (select doc_id, string_split(text, chr(10)) as l from documents)),
lines as (
  select doc_id, pos, raw, list_filter(regexp_split_to_array(
    regexp_replace(raw, '[^{_BLANK}0-9]*[0-9][^{_BLANK}]*', '<*>', 'g'), '[{_BLANK}]+'), lambda x: x <> '') as tokens
  from cut),
long as (
  select doc_id, pos, tokens, len(tokens) as n, tokens[1:{DEPTH}] as leaf from lines
  where strlen(array_to_string(tokens, ' ')) >= {LEAST_BYTES}),
kinds as (select distinct n, leaf, tokens from long where len(tokens) > {DEPTH} + 1),
cells as (
  select n, leaf, tokens, unnest(range({DEPTH}, n)) as place, unnest(tokens[{DEPTH} + 1:]) as token from kinds),
often as (select n, leaf, place, token, count(*) as c from cells group by all),
held as (
  select n, leaf, tokens, place, token,
    row_number() over (partition by n, leaf, tokens order by c desc, place) as r
  from cells join often using (n, leaf, place, token)),
patterns as (
  select n, leaf, tokens, list((place, token) order by place) as template
  from held where r <= ({ALIKE} * (n - {DEPTH}) + 9) // 10 group by n, leaf, tokens),
covered as (select * from patterns qualify count(*) over (partition by n, leaf, template) > 1),
named as (
  select l.doc_id, l.pos, l.n, l.leaf, c.template, case when c.n is null then l.tokens end as own
  from long l left join covered c on l.n = c.n and l.leaf = c.leaf and l.tokens = c.tokens),
recurring as (
  select n, leaf, template, own, count(distinct doc_id) as documents, min((doc_id, pos)) as first
  from named group by n, leaf, template, own),
gone as (
  select m.doc_id, m.pos from named m join recurring r
    on m.n = r.n and m.leaf = r.leaf and m.own is not distinct from r.own and m.template is not distinct from r.template
  where r.documents >= {LEAST_DOCUMENTS} and (m.doc_id, m.pos) <> r.first),
kept as (
  select c.doc_id, count(*) as n_lines, count(g.pos) as n_dropped,
    coalesce(string_agg(c.raw, chr(10) order by c.pos) filter (where g.pos is null), '') as text
  from cut c left join gone g using (doc_id, pos) group by c.doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_dropped, 0) as n_dropped, case when d.text is null then null else k.text end as text
from documents d left join kept k using (doc_id)
"""
