"""Media columns as MPEG transport streams: packing, and reading back with full checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.llm.common import sliced, small_batches, table

UNIT = 576  # bytes of an access unit
PES_UNITS = 64  # access units of an elementary packet
TICKS = 1080  # of the 90 kHz clock an access unit lasts: 576 samples at 48 kHz

# Fixed values of the transport stream format, and the ids that the packer uses.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data

_DEMUX = (
    "payload binary, timestamps array<struct<pts: bigint, start: bigint>>, "
    "random_access array<bigint>, stream_type int, packets bigint, continuity_errors bigint, error string"
)


class StreamError(ValueError):
    """The bytes are no transport stream that can be read."""


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255]) + number.to_bytes(2, "big")
    data = head + bytes([0xC1, 0, 0]) + body
    return data + section_crc(data).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10])
    return (head + b"\0" + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(
    PMT_PID,
    _section(
        2,
        1,
        (0xE000 | ES_PID).to_bytes(2, "big")
        + b"\xf0\0"
        + bytes([STREAM_TYPE])
        + (0xE000 | ES_PID).to_bytes(2, "big")
        + b"\xf0\0",
    ),
)
_HEADS = [[bytes([SYNC, s << 6 | ES_PID >> 8, ES_PID & 255, 0x10 | c]) for c in range(16)] for s in (0, 1)]
_WITH_FIELD = [[h[:3] + bytes([h[3] | 0x20]) for h in x] for x in _HEADS]


def pad(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of the access unit."""
    units = max(1, -(-len(data) // UNIT))
    return data.ljust(units * UNIT, b"\xff")


def _stamp(ticks: int) -> bytes:
    return bytes(
        [0x21 | ticks >> 29 & 14, ticks >> 22 & 255, 1 | ticks >> 14 & 254, ticks >> 7 & 255, 1 | ticks << 1 & 254]
    )


def pack(payload: bytes) -> bytes:
    """A stream of one program: PAT, PMT, then elementary packets that each begin at a random-access point."""
    out, counter = [_PAT, _PMT], 0
    for start in range(0, len(payload), PES_UNITS * UNIT):
        body = payload[start : start + PES_UNITS * UNIT]
        ticks = start // UNIT * TICKS & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\5" + _stamp(ticks) + body
        clock = (ticks << 15 | 0x7E00).to_bytes(6, "big")
        first = min(len(pes), PACKET - 12)
        field = b"\x50" + clock + b"\xff" * (PACKET - 12 - first)
        out += [_WITH_FIELD[1][counter], bytes([len(field)]), field, pes[:first]]
        counter = counter + 1 & 15
        for at in range(first, len(pes), PACKET - 4):
            part = pes[at : at + PACKET - 4]
            spare = PACKET - 4 - len(part)
            if spare:
                out += [_WITH_FIELD[0][counter], bytes([spare - 1]), (b"\0" + b"\xff" * (spare - 2))[: spare - 1]]
            else:
                out.append(_HEADS[0][counter])
            out.append(part)
            counter = counter + 1 & 15
    return b"".join(out)


def _payload(packet: bytes) -> bytes:
    return packet[4 + (packet[4] + 1 if packet[3] & 0x20 else 0) :] if packet[3] & 0x10 else b""


def _read_section(packets: list[bytes]) -> bytes:
    """The section that begins in the first packet, checked; it may go on in the following ones."""
    data = _payload(packets[0])
    data = data[data[0] + 1 :] if data else b""
    for packet in packets[1:]:
        if len(data) >= 3 and len(data) >= 3 + ((data[1] & 15) << 8 | data[2]):
            break
        data += _payload(packet)
    section = data[: 3 + ((data[1] & 15) << 8 | data[2])] if len(data) >= 3 else b""
    if len(section) < 12 or section_crc(section):
        raise StreamError("a table section is cut off or has a wrong checksum")
    return section


def unpack(data: bytes) -> tuple[bytes, list[tuple[int, int]], list[int], int, int, int]:
    """Payload, (pts, payload start) of each elementary packet, byte offsets of random-access points, stream type, packets, continuity errors.

    A packet that repeats the one before it, counter and payload, is read once. A packet marked as
    discontinuous begins a new count.
    """
    if len(data) % PACKET:
        raise StreamError("the length is no multiple of a packet")
    packets = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if not len(packets) or (packets[:, 0] != SYNC).any():
        raise StreamError("a packet lacks its sync byte")
    pids = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]

    def table_of(pid: int) -> bytes:
        at = np.flatnonzero((pids == pid) & (packets[:, 1] & 0x40 > 0))
        if not len(at):
            raise StreamError(f"no table on pid {pid}")
        return _read_section([x.tobytes() for x in packets[(pids == pid) & (np.arange(len(pids)) >= at[0])]])

    pat = table_of(PAT_PID)
    program = next((k for k in range(8, len(pat) - 4, 4) if pat[k] or pat[k + 1]), None)
    if program is None:
        raise StreamError("no program")
    pmt = table_of((pat[program + 2] & 31) << 8 | pat[program + 3])
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    if at + 5 > len(pmt) - 4:
        raise StreamError("the program has no stream")
    kind, pid = pmt[at], (pmt[at + 1] & 31) << 8 | pmt[at + 2]

    own = np.flatnonzero(pids == pid)
    es = packets[own]
    with_field = (es[:, 3] & 0x20) > 0
    begins = np.where(with_field, 5 + es[:, 4].astype(np.int32), 4)
    has_payload = (es[:, 3] & 0x10) > 0
    flags = np.where(with_field & (es[:, 4] > 0), es[:, 5], 0)
    access = (own[(flags & 0x40) > 0] * PACKET).tolist()
    es, begins, flags = es[has_payload], np.minimum(begins[has_payload], PACKET), flags[has_payload]
    steps = (np.diff(es[:, 3] & 15, prepend=es[:1, 3] & 15).astype(np.int64)) % 16
    inside = np.arange(PACKET) >= begins[:, None]
    again = np.zeros(len(es), bool)
    again[1:] = (steps[1:] == 0) & (begins[1:] == begins[:-1]) & ((es[1:] == es[:-1]) | ~inside[1:]).all(1)
    again[1:] &= ~again[:-1]  # once
    fresh = ~again
    counted = (es[fresh, 3] & 15).astype(np.int64)
    errors = int(((np.diff(counted) % 16 != 1) & (flags[fresh][1:] & 0x80 == 0)).sum())
    es, begins = es[fresh], begins[fresh]
    stream = es[np.arange(PACKET) >= begins[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(PACKET - begins)])
    starts = ends[:-1][es[:, 1] & 0x40 > 0].tolist()
    parts, stamps, size = [], [], 0
    for a, b in zip(starts, [*starts[1:], len(stream)], strict=True):
        if stream[a : a + 3] != b"\0\0\1" or b - a < 9:
            raise StreamError("an elementary packet lacks its start code")
        body = stream[a + 9 + stream[a + 8] : b]
        declared = int.from_bytes(stream[a + 4 : a + 6], "big")
        if declared and declared != b - a - 6:
            raise StreamError("an elementary packet is cut off")
        if stream[a + 7] & 0x80:
            s = stream[a + 9 : a + 14]
            ticks = (s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1
            stamps.append((ticks, size))
        parts.append(body)
        size += len(body)
    return b"".join(parts), stamps, access, kind, len(packets), errors


def store(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """Add ``out``: the text's UTF-8 bytes, padded with 255 to whole access units, as a transport stream.

    Null and empty texts give one unit of padding; equal texts give equal bytes; texts of any
    length are stored whole. Other columns stay (one named as ``out`` is replaced).
    """
    keep = [c for c in df.columns if c.lower() != out.lower()]
    schema = df.select(*keep, F.lit(b"").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pack(pad((t or "").encode())) for t in batch.column(text_col).to_pylist()]
            columns = [*(batch.column(c) for c in keep), pa.array(made, pa.binary())]
            yield from sliced(pa.RecordBatch.from_arrays(columns, [*keep, out]))

    return df.mapInArrow(run, schema)


def load(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Read the streams of ``media_col`` back.

    Program tables are parsed and their checksums verified, continuity counters checked, and
    elementary packets put together again. Adds payload, timestamps (pts and payload start),
    random_access (byte offsets at which a reader may begin), stream_type, packets,
    continuity_errors and error; columns of these names are replaced. Null streams give nulls;
    bytes that cannot be read as a stream give nulls and the reason in error.
    """
    made = [f.split(" ")[0] for f in _DEMUX.replace("array<struct<pts: bigint, start: bigint>>", "x").split(", ")]
    keep = [c for c in df.columns if c.lower() not in made]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), _DEMUX])
    kinds = [
        pa.binary(),
        pa.list_(pa.struct([("pts", pa.int64()), ("start", pa.int64())])),
        pa.list_(pa.int64()),
        pa.int32(),
        pa.int64(),
        pa.int64(),
        pa.string(),
    ]

    def read_one(data: bytes | None) -> tuple:
        try:
            return (None,) * len(kinds) if data is None else (*unpack(data), None)
        except (StreamError, IndexError) as e:  # an index beyond a damaged table or packet
            return (*(None,) * (len(kinds) - 1), str(e) if isinstance(e, StreamError) else "a table or packet is cut off")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_one(x) for x in batch.column(media_col).to_pylist()]
            columns = [batch.column(c) for c in keep]
            for k, kind in enumerate(kinds):
                values = [r[k] for r in read]
                if k == 1:
                    values = [v and [{"pts": a, "start": b} for a, b in v] for v in values]
                columns.append(pa.array(values, kind))
            yield from sliced(pa.RecordBatch.from_arrays(columns, [*keep, *made]))

    return df.mapInArrow(run, schema)


def digests(loaded: DataFrame) -> DataFrame:
    """The digest columns, from the stored form and from what was read back."""
    tail = F.expr("substring(payload, -32, 32)")
    feature = F.format_string(
        "units=%d;packets=%d;access=%d;last_pts=%d;errors=%d",
        F.expr(f"length(payload) div {UNIT}"),
        F.col("packets"),
        F.size("random_access"),
        F.element_at("timestamps", -1)["pts"],
        F.col("continuity_errors"),
    )
    return loaded.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    stored = store(docs).select("doc_id", "n_bytes", "media")
    return digests(load(stored))
