"""MPEG transport streams as media columns (ISO/IEC 13818-1).

``store`` multiplexes a payload into a stream of 188-byte packets: a program association table, a program map table,
then packetised elementary stream (PES) packets with timestamps, clock references and random-access marks.  ``read``
takes any such stream: it parses the program tables of all programs and, for every elementary stream in them, checks
continuity counters, drops repeated packets, reassembles the elementary packets and lists timestamps with random-access
points.  A packet that lost a part is reassembled from what is left and marked as not whole.

Defined results: null or empty text is a payload of 64 zero bytes; equal payloads give equal streams; the payload of several elementary
streams is theirs in the order of the tables; rows with equal
ids are independent; columns other than the id and the text are ignored, whatever their names; an empty table gives an
empty one; a null id stays null.  A stream whose length is no multiple of 188, or that has lost its sync bytes or
program tables, is reported with ``error`` and an empty payload, not raised.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from voxloom.llm.common import arrow_map, texts_as_bytes

PACKET, BODY, BLOCK = 188, 184, 64
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
#: Stream ids of padding, and of elementary packets that have no header after their length: fixed values of the standard.
PADDING, WITHOUT_HEADER = 0xBE, {0xBC, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}
#: Bytes of payload in a PES packet, 90 kHz ticks between them, and how many apart random-access points stand.
UNIT_BYTES, UNIT_TICKS, RANDOM_ACCESS_EVERY = 16384, 3600, 4


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 24
    for _ in range(8):
        table = np.where(table & 0x80000000, (table << 1) ^ np.uint32(0x04C11DB7), table << 1).astype(np.uint32)
    return table


CRC_TABLE = [int(x) for x in _crc_table()]


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ CRC_TABLE[(crc >> 24) ^ b]
    return crc


def _section_packet(pid: int, body: bytes) -> bytes:
    section = body + crc32_mpeg(body).to_bytes(4, "big")
    head = bytes((0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0))
    return (head + section).ljust(PACKET, b"\xff")


def program_tables(programs: dict[int, list[tuple[int, int]]] | None = None) -> bytes:
    """The association table, and a map table for each program: its number -> (PID, stream type) of its streams."""
    programs = programs or {1: [(DATA_PID, PRIVATE_DATA)]}
    wide = lambda n: bytes((0xE0 | n >> 8, n & 255))
    maps = {number: PMT_PID + k for k, number in enumerate(programs)}
    entries = b"".join(number.to_bytes(2, "big") + wide(pid) for number, pid in maps.items())
    out = _section_packet(PAT_PID, bytes((0x00, 0xB0, 9 + len(entries), 0, 1, 0xC1, 0, 0)) + entries)
    for number, streams in programs.items():
        listed = b"".join(bytes((kind,)) + wide(pid) + b"\xf0\x00" for pid, kind in streams)
        body = bytes((0x02, 0xB0, 13 + len(listed))) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + wide(streams[0][0]) + b"\xf0\x00" + listed
        out += _section_packet(maps[number], body)
    return out


TABLES = program_tables()


def _stamp(pts: int) -> bytes:
    return bytes((0x21 | (pts >> 29 & 0x0E), pts >> 22 & 255, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 255, 0x01 | (pts << 1 & 0xFE)))


def mux(payload: bytes) -> bytes:
    """One program with one private-data stream."""
    return TABLES + packets_of(payload, DATA_PID)


def packets_of(payload: bytes, pid: int) -> bytes:
    """The packets of one elementary stream."""
    out, counter = [], 0
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data, pts = payload[at : at + UNIT_BYTES], unit * UNIT_TICKS % (1 << 33)
        pes = b"\x00\x00\x01" + bytes((PRIVATE_STREAM_1,)) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        flags = 0x10 | (0x40 if unit % RANDOM_ACCESS_EVERY == 0 else 0)
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")  # base, six reserved bits, extension 0
        first = BODY - 8
        n = 1 + max(0, -(-(len(pes) - first) // BODY))
        rows = np.full((n, PACKET), 0xFF, dtype=np.uint8)
        rows[:, 0] = 0x47
        rows[:, 1] = pid >> 8
        rows[0, 1] |= 0x40
        rows[:, 2] = pid & 255
        rows[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter = (counter + n) & 15
        body = np.frombuffer(pes, dtype=np.uint8)
        rows[0, 3] |= 0x20
        rows[0, 5] = flags
        rows[0, 6:12] = np.frombuffer(clock, dtype=np.uint8)
        if n == 1:
            rows[0, 4] = BODY - 1 - len(body)
            rows[0, PACKET - len(body) :] = body
        else:
            rows[0, 4] = 7
            rows[0, 12:] = body[:first]
            full = (len(body) - first) // BODY
            rows[1 : 1 + full, 4:] = body[first : first + full * BODY].reshape(full, BODY)
            if rest := (len(body) - first) % BODY:
                gap = BODY - rest
                rows[-1, 3] |= 0x20
                rows[-1, 4] = gap - 1
                if gap > 1:
                    rows[-1, 5] = 0
                rows[-1, PACKET - rest :] = body[-rest:]
        out.append(rows.tobytes())
    return b"".join(out)


@dataclass
class Unit:
    """An elementary packet: its timestamp, where its data starts in the stream's, whether it starts at a random-access
    point, and whether nothing of it is lost."""

    pts: int | None
    offset: int
    random_access: bool
    whole: bool


@dataclass
class Elementary:
    program: int
    pid: int
    stream_type: int
    payload: bytes = b""
    units: list[Unit] = field(default_factory=list)
    continuity_errors: int = 0
    repeated: int = 0


@dataclass
class Stream:
    """What ``demux`` found."""

    packets: int = 0
    pids: tuple[int, ...] = ()
    streams: list[Elementary] = field(default_factory=list)
    error: str | None = None

    @property
    def payload(self) -> bytes:
        return b"".join(e.payload for e in self.streams)

    def total(self, name: str) -> int:
        return sum(getattr(e, name) for e in self.streams)


def _sections(rows: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Whole sections with a right checksum that the packets of one PID carry."""
    found: list[bytes] = []
    buffer = b""

    def take(data: bytes) -> bytes:
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 15) << 8 | data[2])
            if len(data) < size:
                return data
            if crc32_mpeg(data[:size]) == 0:
                found.append(data[:size])
            data = data[size:]
        return b""

    for row, offset, start in zip(rows, offsets, starts):
        data = row[offset:].tobytes()
        if start and data:
            take(buffer + data[1 : 1 + data[0]])
            buffer = take(data[1 + data[0] :])
        elif buffer:
            buffer = take(buffer + data)
    return found


def _timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux(media: bytes) -> Stream:
    if not media or len(media) % PACKET:
        return Stream(error="length")
    rows = np.frombuffer(media, dtype=np.uint8).reshape(-1, PACKET)
    got = Stream(packets=len(rows))
    if (rows[:, 0] != 0x47).any():
        return Stream(packets=len(rows), error="sync")
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    starts, control = (rows[:, 1] & 0x40) != 0, rows[:, 3] >> 4 & 3
    adapted = (control & 2) != 0
    offsets = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
    carries = ((control & 1) != 0) & (offsets <= PACKET) & ((rows[:, 1] & 0x80) == 0)
    flags = np.where(adapted & (rows[:, 4] > 0), rows[:, 5], 0)
    got.pids = tuple(int(x) for x in np.unique(pid))

    def of(p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.flatnonzero((pid == p) & carries)
        return rows[k], offsets[k], starts[k]

    programs = {s[i] << 8 | s[i + 1]: (s[i + 2] & 31) << 8 | s[i + 3] for s in _sections(*of(PAT_PID)) if s[0] == 0 for i in range(8, len(s) - 4, 4)}
    programs.pop(0, None)  # the network table
    found: dict[int, Elementary] = {}
    for number, p in programs.items():
        for s in _sections(*of(p)):
            if s[0] == 2 and s[3] << 8 | s[4] == number:
                i = 12 + ((s[10] & 15) << 8 | s[11])
                while i + 5 <= len(s) - 4:
                    own = (s[i + 1] & 31) << 8 | s[i + 2]
                    found.setdefault(own, Elementary(number, own, s[i]))
                    i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    if not found:
        got.error = "program tables"
        return got
    got.streams = list(found.values())
    for e in got.streams:
        k = np.flatnonzero((pid == e.pid) & carries)
        if not _reassemble(e, rows[k], offsets[k], starts[k], flags[k]):
            got.error = "elementary packet"
    return got


def _reassemble(e: Elementary, rows: np.ndarray, offsets: np.ndarray, starts: np.ndarray, flags: np.ndarray) -> bool:
    """Fills ``e`` from the packets of its PID; false if one that starts a unit has no elementary packet."""
    counter = rows[:, 3] & 15
    step = np.diff(counter.astype(np.int64), prepend=counter[:1].astype(np.int64) - 1) & 15
    again = np.zeros(len(rows), dtype=bool)
    for i in np.flatnonzero(step == 0).tolist():
        again[i] = bool((rows[i - 1, 4:] == rows[i, 4:]).all()) and not again[i - 1]
    announced = (flags & 0x80) != 0
    lost = (step != 1) & ~again & ~announced
    e.continuity_errors, e.repeated = int(lost.sum()), int(again.sum())
    keep = ~again
    rows, offsets, starts, flags, lost = rows[keep], offsets[keep], starts[keep], flags[keep], lost[keep]
    sizes = PACKET - offsets
    bodies, ends = rows[np.arange(PACKET) >= offsets[:, None]].tobytes(), np.cumsum(sizes)
    heads = np.flatnonzero(starts).tolist()
    parts, size, right = [], 0, True
    for h, after in zip(heads, [*heads[1:], len(rows)]):
        pes = bodies[ends[h] - sizes[h] : ends[after - 1]]
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 6:
            right = False
            continue
        if pes[3] == PADDING:
            continue
        length = pes[4] << 8 | pes[5]
        plain = pes[3] in WITHOUT_HEADER or len(pes) < 9
        stamp = _timestamp(pes[9:14]) if not plain and pes[7] & 0x80 and len(pes) >= 14 else None
        data = pes[6 if plain else 9 + pes[8] : 6 + length if length else None]
        # a gap before the next unit may have taken the end of one that doesn't tell its length
        torn = bool(lost[h + 1 : after].any()) or (len(pes) < 6 + length if length else after < len(rows) and bool(lost[after]))
        e.units.append(Unit(stamp, size, bool(flags[h] & 0x40), not torn))
        parts.append(data)
        size += len(data)
    e.payload = b"".join(parts)
    return right


def padded(text: bytes) -> bytes:
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a transport stream."""

    def kernel(batch):
        raw = texts_as_bytes(batch.column(1))
        return {"doc_id": batch.column(0), "n_bytes": [len(x) for x in raw], "media": [mux(padded(x)) for x in raw]}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, "doc_id long, n_bytes long, media binary", "text")


def read(media: DataFrame) -> DataFrame:
    """Parses the streams of ``store``, or of any table with (doc_id, n_bytes, media): digests, counts, a row of arrays on
    the units (their stream, timestamp, offset in it, random access, wholeness), and the elementary streams."""

    def described(s: Stream) -> str:
        units = [u for e in s.streams for u in e.units]
        first, last = (units[0].pts, units[-1].pts) if units else (None, None)
        kinds = ",".join(str(e.stream_type) for e in s.streams)
        text = f"ts:packets={s.packets};pids={','.join(map(str, s.pids))};type={kinds};pes={len(units)};rap={sum(u.random_access for u in units)};pts={first}-{last};cc_errors={s.total('continuity_errors')};repeated={s.total('repeated')};torn={sum(not u.whole for u in units)}"
        return text + (f";error={s.error}" if s.error else "")

    def kernel(batch):
        stored = [b"" if x is None else x for x in batch.column(2).to_pylist()]
        got = [demux(x) for x in stored]
        payloads = [s.payload for s in got]
        of_units = lambda f: [[f(i, u) for i, e in enumerate(s.streams) for u in e.units] for s in got]
        return {
            "doc_id": batch.column(0),
            "n_bytes": batch.column(1),
            "payload_bytes": [len(x) for x in payloads],
            "payload_sha256": [hashlib.sha256(x).hexdigest() for x in payloads],
            "tail_crc32": [zlib.crc32(x[-BLOCK:]) for x in payloads],
            "media_bytes": [len(x) for x in stored],
            "media_sha256": [hashlib.sha256(x).hexdigest() for x in stored],
            "feature": [described(s) for s in got],
            "unit_stream": of_units(lambda i, u: i),
            "pts": of_units(lambda i, u: u.pts),
            "unit_offset": of_units(lambda i, u: u.offset),
            "random_access": of_units(lambda i, u: u.random_access),
            "whole": of_units(lambda i, u: u.whole),
            "continuity_errors": [s.total("continuity_errors") for s in got],
            "streams": [[{"program": e.program, "pid": e.pid, "stream_type": e.stream_type, "bytes": len(e.payload), "continuity_errors": e.continuity_errors} for e in s.streams] for s in got],
        }

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, unit_stream array<int>, pts array<long>, unit_offset array<long>, "
        "random_access array<boolean>, whole array<boolean>, continuity_errors long, streams array<struct<program: int, pid: int, stream_type: int, bytes: long, continuity_errors: long>>"
    )
    return arrow_map(media.select("doc_id", "n_bytes", "media"), kernel, schema, "media")
