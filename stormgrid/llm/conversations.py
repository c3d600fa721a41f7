"""Conversation structure repair: the cheapest edits of each conversation, by bidirectional Dijkstra."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.llm.common import materialize, small_batches, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A part of a conversation has at most so many rows, and ends once its texts have so many characters.
PART_ROWS = 512
PART_CHARS = 4 << 20

# States between rows: nothing yet, after s, after u, after a. All but 2 want a u next.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTS_USER = (START, SYSTEM, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}

_WORDS = re.compile(r"[^\x20\x09-\x0D]")


def _after(state: int) -> int:
    """The state after the role that ``state`` wants."""
    return ASSISTANT if state == USER else USER


def _keeps(state: int, initial: str) -> int | None:
    """The state after a row with this initial stays, if it may."""
    if initial == "s":
        return SYSTEM if state == START else None
    return _after(state) if initial == ("a" if state == USER else "u") else None


def _forward(pattern: str, i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(cost, row, state, letter) of the edits that lead on from a place of the lattice."""
    yield INSERT, i, _after(state), "I"
    if i < len(pattern):
        yield DELETE, i + 1, state, "D"
        symbol = pattern[i]
        if symbol != "X":
            extra = TRUNCATED if symbol.isupper() else 0
            yield REROLE + extra, i + 1, _after(state), "R"
            kept = _keeps(state, symbol.lower())
            if kept is not None:
                yield KEEP + extra, i + 1, kept, "K"


def _backward(pattern: str, i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(cost, row, state, letter) of the edits that lead to a place of the lattice."""
    before = WANTS_USER if state == USER else (USER,) if state == ASSISTANT else ()
    for s in before:
        yield INSERT, i, s, "I"
    if i:
        yield DELETE, i - 1, state, "D"
        symbol = pattern[i - 1]
        if symbol != "X":
            extra = TRUNCATED if symbol.isupper() else 0
            for s in before:
                yield REROLE + extra, i - 1, s, "R"
            for s in range(4):
                if _keeps(s, symbol.lower()) == state:
                    yield KEEP + extra, i - 1, s, "K"


def cheapest(pattern: str, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits from ``entry`` to one of ``exits``; of equal ones the ASCII-least audit.

    A forward and a reverse heap grow labels of cost and least audit. Edits that cost nothing go one
    row on, so places of one cost are taken row by row and a label is final when it leaves its heap.
    Labels of one place and cost never begin one another (the longer would have dearer inserts), so
    the least prefix and the least suffix make the least audit. Once the heaps' least costs sum to
    more than the best crossing, an edit of every cheapest path joins a place that the forward side
    has left to one that the reverse side has; of these crossings the least audit stands.
    """
    n = len(pattern)
    labels = [{(0, entry): (0, "")}, {(n, q): (0, "") for q in exits}]
    heaps = [[(0, 0, "", entry)], [(0, -n, "", q) for q in sorted(exits)]]
    done: list[dict[tuple[int, int], tuple[int, str]]] = [{}, {}]
    best: tuple[int, str] | None = None

    def cross(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = cost, audit

    def settle(side: int) -> None:
        cost, i, audit, state = heapq.heappop(heaps[side])
        at = (abs(i), state)
        if at in done[side] or labels[side][at] != (cost, audit):
            return
        done[side][at] = cost, audit
        there = done[1 - side].get(at)
        if there:
            cross(cost + there[0], there[1] + audit if side else audit + there[1])
        step = _backward if side else _forward
        for c, j, q, letter in step(pattern, *at):
            label = (cost + c, letter + audit if side else audit + letter)
            there = done[1 - side].get((j, q))
            if there:
                cross(label[0] + there[0], there[1] + label[1] if side else label[1] + there[1])
            known = labels[side].get((j, q))
            if known is None or label < known:
                labels[side][j, q] = label
                heapq.heappush(heaps[side], (label[0], -j if side else j, label[1], q))

    for _ in exits:
        settle(1)
    while heaps[0] and heaps[1]:
        ahead, behind = heaps[0][0][0], heaps[1][0][0]
        if best is not None and ahead + behind > best[0]:
            break
        settle(0 if ahead <= behind else 1)
    while heaps[0] and (best is None or heaps[0][0][0] <= best[0]) and not heaps[1]:
        settle(0)  # the reverse side has left every place that leads to an exit
    while heaps[1] and (best is None or heaps[1][0][0] <= best[0]) and not heaps[0]:
        settle(1)
    return best


@lru_cache(maxsize=1 << 14)
def whole(pattern: str) -> tuple[int, str]:
    return cheapest(pattern, START, ENDS)


@lru_cache(maxsize=1 << 8)
def between(pattern: str) -> list[tuple[int, str] | None]:
    """The cheapest edits from each state before a part to each state after it."""
    return [cheapest(pattern, s, (t,)) for s in range(4) for t in range(4)]


def symbols(roles: list[str], texts: list[str], seen: set) -> tuple[str, list[int]]:
    """A letter for each row (X: must go; a capital: cut off; o: no role of the grammar) and the numbers of faults."""
    out, faults = [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        key = (role, text)
        last = next((c for c in reversed(text) if _WORDS.match(c)), None)
        if last is None:
            faults[0] += 1
            out.append("X")
        elif key in seen:
            faults[1] += 1
            out.append("X")
        else:
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if last not in ".!?":
                faults[2] += 1
                letter = letter.upper()
            out.append(letter)
        seen.add(key)
    return "".join(out), faults


def breaks(roles: list[str]) -> int:
    """Neighbours whose initials are no legal pair."""
    return sum(a[:1] + b[:1] not in LEGAL for a, b in pairwise(roles))


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> bytes:
    """``role:text`` lines after the edits, joined by line ends."""
    lines, i = [], 0
    for letter in audit:
        if letter != "D":
            to = _keeps(state, roles[i][:1]) if letter == "K" else _after(state)
            role = roles[i] if letter == "K" else NAMES[to]
            lines.append(f"{role}:{'' if letter == 'I' else texts[i]}")
            state = to
        i += letter != "I"
    return "\n".join(lines).encode()


def turns_of(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """The first and last turn that is not null, and how many different ones; turns are sorted."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


_RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_PART = f"part bigint, roles array<string>, texts array<string>, turns array<bigint>, {_RESULT}"
_ROUTES = (
    "conv_id bigint, part bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string, "
    "first_turn bigint, last_turn bigint, n_turns bigint, costs array<bigint>, audits array<string>"
)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _batches(rows: Iterator[dict], ddl: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded number and text size."""
    schema, held, size = _schema(ddl), [], 0
    for row in rows:
        held.append(row)
        size += 500 + sum(map(len, row.get("texts") or ())) + len(row.get("audit") or "") + len(row.get("blob") or b"")
        if len(held) >= 2000 or size > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def _solved(conv_id: int | None, roles: list[str], texts: list[str], turns: list[int | None]) -> dict:
    pattern, faults = symbols(roles, texts, set())
    cost, audit = whole(pattern)
    first, last, n = turns_of(turns)
    return {
        "conv_id": conv_id, "gaps": last - first + 1 - n if n else 0, "blank": faults[0], "duplicate": faults[1], "truncated": faults[2],
        "illegal": breaks(roles), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(repaired(roles, texts, audit, START)).hexdigest(),
    }


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solve the conversations that lie inside a partition, and cut up long ones and those at its ends."""

    def rows() -> Iterator[dict]:
        part = TaskContext.get().partitionId() << 33
        roles, texts, turns, size = [], [], [], 0
        cut, first, conv = True, True, None  # an earlier partition may hold rows of the first conversation

        def piece() -> dict:
            nonlocal part, roles, texts, turns, size
            out = {"part": part, "conv_id": conv, "roles": roles, "texts": texts, "turns": turns}
            part, roles, texts, turns, size = part + 1, [], [], [], 0
            return out

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))
            for conv_id, turn, role, text, copies in zip(*columns, strict=True):
                if first or conv_id != conv:
                    if not first:
                        if cut:
                            yield piece()
                        else:
                            yield _solved(conv, roles, texts, turns)
                            roles, texts, turns, size = [], [], [], 0
                        cut = False
                    conv, first = conv_id, False
                for _ in range(copies):
                    if len(roles) >= PART_ROWS or size >= PART_CHARS:
                        yield piece()
                        cut = True
                    roles.append(role)
                    texts.append(text)
                    turns.append(turn)
                    size += len(text)
        if not first:
            yield piece()

    return _batches(rows(), _PART)


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                earlier = set(r["earlier"] or ())
                keys = r["keys"]
                seen = {(a, b) for a, b, k in zip(r["roles"], r["texts"], keys, strict=True) if k in earlier}
                pattern, faults = symbols(r["roles"], r["texts"], seen)
                first, last, n = turns_of(r["turns"])
                found = between(pattern)
                yield {
                    "conv_id": r["conv_id"], "part": r["part"], "blank": faults[0], "duplicate": faults[1], "truncated": faults[2], "illegal": breaks(r["roles"]),
                    "first_role": r["roles"][0][:1] if r["roles"] else None, "last_role": r["roles"][-1][:1] if r["roles"] else None,
                    "first_turn": first, "last_turn": last, "n_turns": n, "costs": [x and x[0] for x in found], "audits": [x and x[1] for x in found],
                }

    return _batches(rows(), _ROUTES)


class _Fold:
    """The parts of one conversation, joined from left to right."""

    def __init__(self) -> None:
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.role = self.first = self.last = None
        self.n_turns = 0
        self.labels: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.agreed: list[str] = []  # what all labels begin with
        self.parts: list[tuple[int, bytes]] = []  # the state before, for each state after

    def add(self, r: dict) -> None:
        for k in self.sums:
            self.sums[k] += r[k]
        if r["first_role"] is not None:
            self.sums["illegal"] += self.role is not None and self.role + r["first_role"] not in LEGAL
            self.role = r["last_role"]
        if r["first_turn"] is not None:
            self.n_turns += r["n_turns"] - (r["first_turn"] == self.last)
            self.first, self.last = r["first_turn"] if self.first is None else self.first, r["last_turn"]
        labels, back = [], []
        for t in range(4):
            ways = [
                (x[0] + r["costs"][4 * s + t], x[1] + r["audits"][4 * s + t], s)
                for s, x in enumerate(self.labels) if x is not None and r["costs"][4 * s + t] is not None
            ]
            least = min(ways, default=None)
            labels.append(least and least[:2])
            back.append(least[2] if least else 0)
        self.parts.append((r["part"], bytes(back)))
        common = commonprefix([x[1] for x in labels if x])
        self.agreed.append(common)
        self.labels = [x and (x[0], x[1][len(common) :]) for x in labels]

    def rows(self, conv_id: int | None) -> Iterator[dict]:
        cost, tail, state = min((*self.labels[t], t) for t in ENDS if self.labels[t])
        gaps = self.last - self.first + 1 - self.n_turns if self.n_turns else 0
        yield {"conv_id": conv_id, "gaps": gaps, **self.sums, "cost": cost, "audit": "".join(self.agreed) + tail}
        for part, back in reversed(self.parts):
            yield {"conv_id": conv_id, "part": part, "entry": back[state], "exit": state}
            state = back[state]


_FOLDED = f"part bigint, entry bigint, exit bigint, {_RESULT}"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        fold, conv = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if fold is None or r["conv_id"] != conv:
                    if fold:
                        yield from fold.rows(conv)
                    fold, conv = _Fold(), r["conv_id"]
                fold.add(r)
        if fold:
            yield from fold.rows(conv)

    return _batches(rows(), _FOLDED)


_BLOBS = "conv_id bigint, part bigint, blob binary"


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                pattern, _ = symbols(r["roles"], r["texts"], {(a, b) for a, b, k in zip(r["roles"], r["texts"], r["keys"], strict=True) if k in set(r["earlier"] or ())})
                audit = cheapest(pattern, r["entry"], (r["exit"],))[1]
                yield {"conv_id": r["conv_id"], "part": r["part"], "blob": repaired(r["roles"], r["texts"], audit, r["entry"])}

    return _batches(rows(), _BLOBS)


_HASHES = "conv_id bigint, repaired_sha256 string"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's blobs in order, read as a stream."""

    def rows() -> Iterator[dict]:
        state, conv, begun = None, None, False
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != conv:
                    if state:
                        yield {"conv_id": conv, "repaired_sha256": state.hexdigest()}
                    state, conv, begun = hashlib.sha256(), r["conv_id"], False
                if r["blob"]:
                    state.update(b"\n" * begun + r["blob"])
                    begun = True
        if state:
            yield {"conv_id": conv, "repaired_sha256": state.hexdigest()}

    return _batches(rows(), _HASHES)


def repair(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation; ``rows`` has conv_id, turn, role, text and copies.

    Rows are read ``copies`` times in the order of turn (nulls first), of one turn by role and a hash
    of the text; a conversation whose rows all have 0 copies is empty, and still has a row. Null role
    and text count as one space; null conv_id is one conversation. Roles count by their initial; a
    role with another than s, u, a cannot be kept.

    Range partitions of (conv_id, turn, ...) hold neighbours together, and split a conversation of
    any size, even one of equal rows. Those inside a partition are solved there, once for each
    pattern of faults. Long ones, and those at the ends of a partition, are cut into parts of
    ``PART_ROWS``: each part finds the cheapest edits from every state before it to every state
    after it, which are put together by conversation as rows of a few hundred bytes. Then each part
    writes its repaired lines as one row, and one task hashes the rows of a conversation in order as
    a stream, as sha256 cannot be split. The audit of a conversation is one value and must fit one.
    """
    space = F.lit(" ")
    named = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.col("copies").cast("int").alias("copies"),
    )
    order = ["conv_id", "turn", "role", "text_hash", "row_no"]
    placed = named.withColumns({"text_hash": F.xxhash64("text"), "row_no": F.monotonically_increasing_id()})
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once: a second run of the plan may draw other range bounds.
    parts = materialize(ranged.select("conv_id", "turn", "role", "text", "copies").mapInArrow(_parts, _PART), "conversations")
    result = [c.split(" ")[0] for c in _RESULT.split(", ")]
    solved = parts.where("part is null").select(*result)
    key = F.zip_with("roles", "texts", lambda r, t: F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    cut = parts.where("part is not null").select("conv_id", "part", "roles", "texts", "turns", key.alias("keys"))
    # Texts that an earlier part of the conversation has; a part sends each once.
    sent = cut.select(F.coalesce("conv_id", F.lit(0)).alias("conv"), F.isnull("conv_id").alias("none"), "part", F.explode(F.array_distinct("keys")).alias("key"))
    first = sent.groupBy("conv", "none", "key").agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1")
    earlier = sent.join(first.drop("n"), ["conv", "none", "key"]).where("part > first").groupBy("part").agg(F.collect_list("key").alias("earlier"))
    cut = materialize(cut.join(earlier, "part", "left").select("conv_id", "part", "roles", "texts", "turns", "keys", "earlier"), "conversations")

    def together(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    folded = materialize(together(cut.mapInArrow(_routes, _ROUTES)).mapInArrow(_folded, _FOLDED), "conversations")
    way = folded.where("part is not null").select("part", "entry", "exit")
    blobs = cut.join(way, "part").select("conv_id", "part", "roles", "texts", "keys", "earlier", "entry", "exit").mapInArrow(_blobs, _BLOBS)
    hashes = together(blobs).mapInArrow(_hashes, _HASHES)
    sums = folded.where("part is null").drop("part", "entry", "exit", "repaired_sha256")
    same = sums["conv_id"].eqNullSafe(hashes["conv_id"])
    put = sums.join(hashes, same).select(*(sums[c] for c in result[:-1]), "repaired_sha256")
    return solved.unionByName(put)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the registered query's damage, by crc32 of ``conv_id:turn`` (nulls: one space)."""
    space = F.lit(" ")
    spot = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(spot.cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same by dynamic programming: labels of nine digits of cost and the audit, the least of each state, row after row."""

    def plus(state: str, cost: str | int, letter: str) -> str:
        return f"(lpad(cast(cast(left({state}, 9) as int) + {cost} as varchar), 9, '0') || substr({state}, 10) || '{letter}')"

    extra = f"(case when fault = 3 then {TRUNCATED} else 0 end)"
    may = "case when fault not in (1, 2) then {} end"
    reroled = [plus(f"s{q}", f"{REROLE} + {extra}", "R") for q in range(4)]
    kept = [plus(f"s{q}", extra, "K") for q in range(4)]
    deleted = [plus(f"s{q}", DELETE, "D") for q in range(4)]

    def when(initial: str, *ways: str) -> str:
        return f"case when fault not in (1, 2) and i = '{initial}' then least({', '.join(ways)}) end" if len(ways) > 1 else f"case when fault not in (1, 2) and i = '{initial}' then {ways[0]} end"

    step = {
        0: deleted[0],
        1: f"least({deleted[1]}, {when('s', kept[0])})",
        2: f"least({deleted[2]}, {may.format(f'least({reroled[0]}, {reroled[1]}, {reroled[3]})')}, {when('u', kept[0], kept[1], kept[3])})",
        3: f"least({deleted[3]}, {may.format(reroled[2])}, {when('a', kept[2])})",
    }
    inserts = lambda: f"least(t2, {plus('t0', INSERT, 'I')}, {plus('t1', INSERT, 'I')}, {plus('t3', INSERT, 'I')})"
    moves = "case when state = 2 then 3 else 2 end"
    return f"""with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_reduce(list_prepend(4294967295::bigint,
  flatten(list_transform(range(1, strlen(key) + 1), lambda j: [ascii(key[j])::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)) as crc
  from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations) q),
g as materialized (select conv_id, turn, role, text, xor(crc, 4294967295) % 20 as kind from k),
d as materialized (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, copy from g, unnest(case kind when 0 then [] when 3 then [1, 2] else [1] end) u(copy)),
o as materialized (select *, left(role, 1) as i, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth from d),
r as materialized (select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 1 when nth > 1 then 2 when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 3 else 0 end as fault,
  case when lag(i) over (partition by conv_id order by n) || i not in ('su', 'ua', 'au') then 1 else 0 end as illegal from o),
c as materialized (select conv_id, case when count(turn) > 0 then max(turn) - min(turn) + 1 - count(distinct turn) else 0 end as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, sum(illegal)::bigint as illegal, count(*) as n_rows from r group by 1),
p(conv_id, n, s0, s1, s2, s3) as (select distinct conv_id, 0::bigint, '000000000', null::varchar, '000000005I', '000000010II' from g
  union all select conv_id, n, t0, t1, {inserts()}, least(t3, {plus(inserts(), INSERT, 'I')}) from (
    select p.conv_id, p.n + 1 as n, {', '.join(f'{x} as t{q}' for q, x in step.items())} from p join r on r.conv_id is not distinct from p.conv_id and r.n = p.n + 1) q),
e as materialized (select conv_id, left(b, 9)::bigint as cost, substr(b, 10) as audit from (select p.conv_id, least(s0, s3) as b from p left join c on c.conv_id is not distinct from p.conv_id where p.n = coalesce(c.n_rows, 0)) q),
w(conv_id, audit, z, n, state, lines) as (select conv_id, audit, 0, 0::bigint, 0, []::varchar[] from e
  union all select w.conv_id, audit, z + 1, w.n + case when x = 'I' then 0 else 1 end, case x when 'D' then state when 'K' then case when state = 0 and r.i = 's' then 1 else {moves} end else {moves} end,
    case x when 'D' then lines when 'K' then list_append(lines, r.role || ':' || r.text) else list_append(lines, case when state = 2 then 'assistant:' else 'user:' end || case x when 'R' then r.text else '' end) end
  from (select *, audit[z + 1] as x from w where z < length(audit)) w left join r on r.conv_id is not distinct from w.conv_id and r.n = w.n + 1)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, e.cost, e.audit, sha256(array_to_string(lines, chr(10))) as repaired_sha256
from e left join c on c.conv_id is not distinct from e.conv_id join w on w.conv_id is not distinct from e.conv_id and z = length(w.audit)"""


SQL = _sql()
