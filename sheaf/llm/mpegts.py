"""Media columns: payloads as MPEG transport streams (ISO/IEC 13818-1).

`mux` stores bytes as 8-bit samples in one private elementary stream: program tables before every
random-access point, packetised elementary packets with presentation times, a clock reference and
the random-access flag in the adaptation field. `demux` follows the tables over sections of any
number of packets, passes over packets that are sent twice, checks continuity counters and the
time between elementary packets, and reassembles those that came whole. One that didn't gives no
sample: its place in the index says so.

Defined results: a null or empty text is stored as 64 zero bytes; equal texts give equal media
whatever their rows hold else; repeated rows, and rows without a doc_id, have a result each; an empty
table gives an empty result. Media without tables or synchronisation are a ValueError. Where packets are
missing `read_media` raises one too, or, if it is told not to, counts them and describes what is left.
The input's other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import chunks, texts_of

PACKET, PMT_PID, ES_PID, PROGRAM = 188, 0x1000, 0x100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
RATE, CLOCK = 8000, 90_000  # samples and ticks a second
UNIT = 16_384  # samples of an elementary packet
RANDOM_ACCESS = 4  # every so many packets can be started from
PES_HEAD, CLOCK_FIELD = 14, 8


def _crc_table() -> list[int]:
    rows = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        rows.append(c)
    return rows


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, ident, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc_mpeg(head + body))


def _psi_packet(pid: int, section: bytes) -> np.ndarray:
    raw = struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


PAT = _psi_packet(0, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
PMT = _psi_packet(PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000)))


def _time(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _pts(b) -> int:
    return (int(b[0]) & 0x0E) << 29 | int(b[1]) << 22 | (int(b[2]) & 0xFE) << 14 | int(b[3]) << 7 | int(b[4]) >> 1


def mux(payload: np.ndarray) -> np.ndarray:
    """The transport stream of a payload (uint8, not empty)."""
    parts: list[np.ndarray] = []
    es_cc = psi_cc = 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        pts = at * CLOCK // RATE & (1 << 33) - 1
        start = k % RANDOM_ACCESS == 0
        if start:
            tables = np.stack([PAT, PMT])
            tables[:, 3] |= psi_cc & 15
            psi_cc += 1
            parts.append(tables.reshape(-1))
        head = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + _time(pts)
        pes = np.concatenate([np.frombuffer(head, np.uint8), data])
        room = PACKET - 4 - (CLOCK_FIELD if start else 0)
        first = min(len(pes), room)
        full, rest = divmod(len(pes) - first, PACKET - 4)
        n = 1 + full + (rest > 0)
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (es_cc + np.arange(n)) & 15
        es_cc += n
        field = PACKET - 4 - first
        if field:
            out[0, 3] |= 0x20
            out[0, 4] = field - 1
            if field > 1:
                out[0, 5] = 0x50 if start else 0
            if start:
                out[0, 6:12] = np.frombuffer(struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00), np.uint8)
        out[0, PACKET - first :] = pes[:first]
        if full:
            out[1 : 1 + full, 4:] = pes[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if rest:
            field = PACKET - 4 - rest
            out[-1, 3] |= 0x20
            out[-1, 4] = field - 1
            if field > 1:
                out[-1, 5] = 0
            out[-1, PACKET - rest :] = pes[len(pes) - rest :]
        parts.append(out.reshape(-1))
    return np.concatenate(parts)


def _offsets(packets: np.ndarray) -> np.ndarray:
    """Where each packet's payload starts."""
    return np.where(packets[:, 3] & 0x20 > 0, 5 + packets[:, 4].astype(np.int32), 4)


def _in_turn(packets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one PID's packets with a payload: those that aren't sent a second time, and which of them don't follow on the one before."""
    cc = packets[rows, 3] & 15
    again = np.flatnonzero((cc[1:] - cc[:-1]) & 15 == 0) + 1
    if len(again):
        dup = np.zeros(len(rows), bool)
        for i in again:
            x, y = packets[rows[i - 1]], packets[rows[i]]
            at = int(_offsets(y[None])[0])
            dup[i] = not dup[i - 1] and np.array_equal(x[1:4], y[1:4]) and np.array_equal(x[at:], y[at:])
        rows = rows[~dup]
        cc = packets[rows, 3] & 15
    gap = np.zeros(len(rows), bool)
    gap[1:] = (cc[1:] - cc[:-1]) & 15 != 1
    if gap.any():
        own = packets[rows]
        gap &= ~((own[:, 3] & 0x20 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x80 > 0))  # a break that is announced
    return rows, gap


def _read_section(packets: np.ndarray, rows: np.ndarray, gap: np.ndarray, table_id: int, what: str) -> bytes:
    """The first whole section that starts in the packets rows of one PID."""
    for k in np.flatnonzero(packets[rows, 1] & 0x40):
        offset = _offsets(packets[rows[k : k + 1]])[0]
        raw = packets[rows[k]].tobytes()[offset:]
        raw, j = raw[1 + raw[0] :], k + 1
        while j < len(rows) and not packets[rows[j], 1] & 0x40 and not gap[j] and (len(raw) < 3 or len(raw) < 3 + (struct.unpack_from(">H", raw, 1)[0] & 0xFFF)):
            raw += packets[rows[j]].tobytes()[_offsets(packets[rows[j : j + 1]])[0] :]
            j += 1
        if len(raw) < 3:
            continue
        section = raw[: 3 + (struct.unpack_from(">H", raw, 1)[0] & 0xFFF)]
        if len(section) >= 12 and section[0] == table_id and not crc_mpeg(section) and len(section) == 3 + (struct.unpack_from(">H", section, 1)[0] & 0xFFF):
            return section
    raise ValueError(f"no sound {what}")


def demux(media: np.ndarray) -> tuple[np.ndarray, dict]:
    """The samples of a transport stream, and what was found on the way.

    The index lists for each elementary packet its time, its first transport packet, whether it is a random-access
    point and whether it came whole. Samples are those of whole ones. cc_errors counts breaks in the continuity
    counters of tables and stream, lost the elementary packets that aren't whole, time_gaps those that don't follow on the one before.
    """
    if len(media) == 0 or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = media.reshape(-1, PACKET)
    if not (packets[:, 0] == 0x47).all():
        raise ValueError("lost synchronisation")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    loaded = packets[:, 3] & 0x10 > 0
    errors = 0

    def stream(which: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal errors
        rows, gap = _in_turn(packets, np.flatnonzero((pid == which) & loaded))
        errors += int(gap.sum())
        return rows, gap

    pat = _read_section(packets, *stream(0), 0, "program association table")
    entries = [struct.unpack_from(">HH", pat, k) for k in range(8, len(pat) - 4, 4)]
    program = next((p & 0x1FFF for number, p in entries if number), None)  # program 0 names the network's PID
    if program is None:
        raise ValueError("the program association table names no program")
    pmt = _read_section(packets, *stream(program), 2, "program map table")
    at = 12 + (struct.unpack_from(">H", pmt, 10)[0] & 0xFFF)
    if at + 5 > len(pmt) - 4:
        raise ValueError("the program map table names no stream")
    stream_type, es_pid = pmt[at], struct.unpack_from(">H", pmt, at + 1)[0] & 0x1FFF
    rows, gap = stream(es_pid)
    es = packets[rows]
    offset = _offsets(es)
    access = (es[:, 3] & 0x20 > 0) & (es[:, 4] > 0) & (es[:, 5] & 0x40 > 0)
    data = es[np.arange(PACKET) >= offset[:, None]]
    ends = np.cumsum(PACKET - offset)
    opens = np.flatnonzero(es[:, 1] & 0x40)
    begin = ends[opens] - (PACKET - offset[opens])
    broken = np.concatenate([[0], np.cumsum(gap)])
    pieces, index, lost, time_gaps, due = [], [], 0, 0, None
    for b, e, k, last in zip(begin, np.append(begin[1:], len(data)), opens, np.append(opens[1:], len(es))):
        part = data[b:e]
        if bytes(part[:3]) != b"\0\0\1" or len(part) < 9:
            raise ValueError("no elementary packet where one is announced")
        head, size = 9 + int(part[8]), int(part[4]) << 8 | int(part[5])
        pts = _pts(part[9:14]) if part[7] & 0x80 and len(part) >= 14 else None
        whole = broken[last] == broken[k + 1] and len(part) >= head and (not size or len(part) == 6 + size)
        if due is not None and pts is not None and pts != due:
            time_gaps += 1
        due = None
        if whole:
            samples = part[head:]
            pieces.append(samples)
            if pts is not None:
                due = pts + len(samples) * CLOCK // RATE & (1 << 33) - 1
        lost += not whole
        index.append((pts, int(rows[k]), bool(access[k]), bool(whole)))
    if len(opens) == 0 or opens[0] > 0:
        lost += 1  # what comes before the first start
    samples = pieces[0] if len(pieces) == 1 else np.concatenate(pieces or [np.zeros(0, np.uint8)])
    return samples, {"stream_type": stream_type, "packets": len(packets), "cc_errors": errors, "lost": lost, "time_gaps": time_gaps, "index": index}


def padded(text: np.ndarray) -> np.ndarray:
    """text with zeros up to a positive multiple of 64."""
    return np.concatenate([text, np.zeros(64 if len(text) == 0 else -len(text) % 64, np.uint8)])


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the transport stream of the padded text."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2 << 20, 5_000):
                texts = texts_of(part.column(1))
                media = [mux(padded(texts.one(i))).tobytes() for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts.lens), pa.array(media, pa.binary())], schema=out)

    return docs.select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame, strict: bool = True) -> DataFrame:
    """The streams of with_media, read back: digests of samples and media, errors, and the index of times and random-access points.

    strict: missing packets are an error. Else the digests are those of the elementary packets that came whole.
    """
    index = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_()), ("whole", pa.bool_())]))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("cc_errors", pa.int32()), ("lost", pa.int32()), ("index", index)]
    out = pa.schema(fields)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 4 << 20, 5_000, "media"):
                media, rows = texts_of(part.column(2)), []
                for i in range(len(media)):
                    stored = media.one(i)
                    samples, found = demux(stored)
                    if strict and (found["cc_errors"] or found["lost"] or found["time_gaps"]):
                        raise ValueError(f"packets are missing in the media of doc_id {part.column(0)[i]}: {found['cc_errors']} breaks, {found['lost']} elementary packets lost, {found['time_gaps']} gaps in time")
                    at = found["index"]
                    span = f"{at[0][0]}-{at[-1][0]}" if at else "-"
                    mean = samples.mean() if len(samples) else 0.0
                    feature = f"type={found['stream_type']};packets={found['packets']};pes={len(at)};rap={sum(x[2] for x in at)};pts={span};mean={mean:.4f}"
                    rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, found["cc_errors"], found["lost"], [{"pts": a, "packet": b, "random_access": c, "whole": d} for a, b, c, d in at]))
                columns = [pa.array(c, f[1]) for c, f in zip(zip(*rows), fields[2:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], schema=out)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(parse, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, cc_errors int, lost int, index array<struct<pts:long,packet:long,random_access:boolean,whole:boolean>>")
