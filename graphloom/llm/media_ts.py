"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

``store`` puts the bytes of each row into a transport stream: program tables,
then elementary packets (PES) of a private stream with time stamps, cut into
packets of 188 bytes. ``read`` parses such streams: it follows the program
tables to the elementary stream, checks the continuity counters, reassembles
the elementary packets, and returns their payload with the time stamps and the
random-access points.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, utf8_buffer

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0, 0x1FFF
PMT_PID, DATA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x100, 0x101, 1, 0x06, 0xBD
CLOCK = 90_000
#: Bytes of payload in one elementary packet, and samples of 8 bits a second.
UNIT_BYTES, SAMPLE_RATE = 16_384, 48_000
#: Every so many elementary packets the tables are repeated and a random-access point is set.
ACCESS_EVERY = 4
PES_HEADER = 14


class BrokenStream(ValueError):
    """The bytes are no transport stream that this module can read."""


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, no reflection, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (5 + len(body) + 4), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


@functools.lru_cache(1)
def table_packets() -> np.ndarray:
    """The packets of the program association and the program map table (counters zero)."""
    pat = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))
    rows = [struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + s for pid, s in ((PAT_PID, pat), (PMT_PID, pmt))]
    return np.frombuffer(b"".join(r.ljust(PACKET, b"\xff") for r in rows), np.uint8).reshape(2, PACKET)


def pts_bytes(pts: int) -> bytes:
    """The five bytes of a 33-bit presentation time stamp, with marker bits."""
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def pts_value(raw: bytes) -> int:
    return (raw[0] & 0x0E) << 29 | raw[1] << 22 | (raw[2] & 0xFE) << 14 | raw[3] << 7 | raw[4] >> 1


def unit_packets(payload: np.ndarray, number: int, counter: int, access: bool) -> np.ndarray:
    """The packets of one elementary packet: a header with its time stamp, then the payload."""
    pts = (number * UNIT_BYTES * CLOCK // SAMPLE_RATE) & (2**33 - 1)
    pes = np.empty(PES_HEADER + len(payload), np.uint8)
    pes[:PES_HEADER] = np.frombuffer(struct.pack(">IHBBB", 0x100 | STREAM_ID, 8 + len(payload), 0x80, 0x80, 5) + pts_bytes(pts), np.uint8)
    pes[PES_HEADER:] = payload
    first_adaptation = 2 if access else 0  # length and flags
    first = min(len(pes), PACKET - 4 - first_adaptation)
    n = 1 + -(-(len(pes) - first) // (PACKET - 4))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = SYNC
    out[:, 1], out[:, 2] = DATA_PID >> 8, DATA_PID & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    if n > 2:
        out[1:-1, 4:] = pes[first : first + (n - 2) * (PACKET - 4)].reshape(n - 2, PACKET - 4)
    # the first and the last packet may hold an adaptation field: flags, and stuffing up to the packet's end
    for row, chunk in ((0, pes[:first]),) + (((n - 1, pes[first + (n - 2) * (PACKET - 4) :]),) if n > 1 else ()):
        spare = PACKET - 4 - len(chunk)
        if spare:
            out[row, 3] |= 0x20
            out[row, 4] = spare - 1
            if spare > 1:
                out[row, 5] = 0x40 if row == 0 and access else 0
        out[row, PACKET - len(chunk) :] = chunk
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream that holds these bytes."""
    data, parts, counter = np.frombuffer(payload, np.uint8), [], 0
    for number in range(max(1, -(-len(data) // UNIT_BYTES))):
        access = number % ACCESS_EVERY == 0
        if access:
            tables = table_packets().copy()
            tables[:, 3] |= number // ACCESS_EVERY & 15
            parts.append(tables)
        packets = unit_packets(data[number * UNIT_BYTES : (number + 1) * UNIT_BYTES], number, counter, access)
        counter = (counter + len(packets)) & 15
        parts.append(packets)
    return np.concatenate(parts).tobytes()


@functools.lru_cache(1024)
def parse_section(raw: bytes) -> tuple[int, int, bytes]:
    """Table id, number and body of a section; its checksum must hold."""
    raw = raw[1 + raw[0] :]
    size = 3 + (struct.unpack(">H", raw[1:3])[0] & 0x0FFF)
    if size < 12 or size > len(raw) or section_crc(raw[:size]):
        raise BrokenStream("a program table's checksum does not hold")
    return raw[0], struct.unpack(">H", raw[3:5])[0], raw[8 : size - 4]


def _pid_in(raw: bytes) -> int:
    return struct.unpack(">H", raw)[0] & 0x1FFF


def demux(stream: bytes) -> dict:
    """payload, and of its elementary packets pts, random_access (indexes), packets, pid, stream_type, discontinuities."""
    if len(stream) == 0 or len(stream) % PACKET:
        raise BrokenStream("the length is not a multiple of 188")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any() or (p[:, 1] & 0x80).any():
        raise BrokenStream("a packet lacks its sync byte or is marked as damaged")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    control = p[:, 3] >> 4 & 3

    def tables(of: int, wanted: int) -> list[tuple[int, int, bytes]]:
        return [x for x in map(parse_section, {p[i, 4:].tobytes() for i in np.flatnonzero((pid == of) & (p[:, 1] & 0x40 > 0))}) if x[0] == wanted]

    programs = {_pid_in(b[k + 2 : k + 4]) for _, _, b in tables(PAT_PID, 0) for k in range(0, len(b), 4) if b[k : k + 2] != b"\0\0"}
    streams = {}
    for of in programs:
        for _, _, body in tables(of, 2):
            k = 4 + (struct.unpack(">H", body[2:4])[0] & 0x0FFF)
            while k + 5 <= len(body):
                streams[_pid_in(body[k + 1 : k + 3])] = body[k]
                k += 5 + (struct.unpack(">H", body[k + 3 : k + 5])[0] & 0x0FFF)
    if len(streams) != 1:
        raise BrokenStream(f"the program tables name {len(streams)} elementary streams; one is expected")
    data_pid, stream_type = next(iter(streams.items()))
    own = p[(pid == data_pid) & (control & 1 == 1)]
    counters = own[:, 3].astype(np.int16) & 15
    jumps = int((np.diff(counters) % 16 != 1).sum())
    adapted = own[:, 3] >> 5 & 1 == 1
    begin = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4)
    if (begin > PACKET).any():
        raise BrokenStream("an adaptation field is longer than its packet")
    flags = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    if not len(starts) or starts[0] != 0:
        raise BrokenStream("the stream does not begin with an elementary packet")
    body = own[np.arange(PACKET) >= begin[:, None]]
    ends = np.concatenate([[0], np.cumsum(PACKET - begin)])
    payload, pts = [], []
    for a, b in zip(ends[starts].tolist(), [*ends[starts[1:]].tolist(), len(body)]):
        head = body[a : a + PES_HEADER].tobytes()
        if len(head) < PES_HEADER or head[:3] != b"\0\0\1" or not head[7] & 0x80:
            raise BrokenStream("an elementary packet lacks its start code or time stamp")
        size = struct.unpack(">H", head[4:6])[0]
        if size != b - a - 6:
            raise BrokenStream("an elementary packet is not whole")
        pts.append(pts_value(head[9:14]))
        payload.append(body[a + 9 + head[8] : b])
    return {"payload": np.concatenate(payload).tobytes(), "pts": pts, "random_access": np.flatnonzero(flags[starts] & 0x40).tolist(), "packets": len(p), "pid": data_pid, "stream_type": stream_type, "discontinuities": jumps}


def padded(raw: bytes, multiple: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple."""
    return raw.ljust(max(multiple, -(-len(raw) // multiple) * multiple), b"\0")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 bytes of each whole text, padded, as a transport stream.

    Null and empty texts are stored as 64 zero bytes; texts of any length make as many elementary packets as they need.
    Equal texts give equal media, repeated rows give repeated rows, other columns are not read.
    """

    def run(batches):
        for batch in batches:
            data, offsets = utf8_buffer(batch.column(1))
            raw, at, ids = data.tobytes(), offsets.tolist(), batch.column(0)
            for i in range(0, len(ids), 256):  # a few MB at a time
                spans = list(zip(at[i : i + 256], at[i + 1 : i + 257]))
                yield pa.RecordBatch.from_arrays([ids[i : i + 256], pa.array([b - a for a, b in spans], pa.int64()), pa.array([mux(padded(raw[a:b])) for a, b in spans], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame, payload: bool = True) -> DataFrame:
    """doc_id, n_bytes, media -> what the streams hold: payload (binary), pts and random_access arrays, counts, and digests.

    A null medium gives nulls; damaged bytes raise BrokenStream with the reason. ``payload`` false: that column is null.
    """
    keep = payload

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(2).to_pylist():
                if raw is None:
                    rows.append((None,) * 10)
                    continue
                got = demux(raw)
                data, pts = got["payload"], got["pts"]
                feature = f"pid={got['pid']};type={got['stream_type']};packets={got['packets']};units={len(pts)};jumps={got['discontinuities']};first_pts={pts[0]};last_pts={pts[-1]};access={','.join(map(str, got['random_access']))}"
                rows.append((data if keep else None, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, pts, got["random_access"], got["discontinuities"]))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32())
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=READ_COLUMNS)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<int>, discontinuities int")


READ_COLUMNS = ["doc_id", "n_bytes", "payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access", "discontinuities"]
