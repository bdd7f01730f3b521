"""Media columns as MPEG transport streams.

``mux`` stores a payload of 8-bit samples as one program: a program association table, a program
map table and a private elementary stream whose packets carry time stamps, clock references and
random-access marks. ``demux`` reads such a stream back: it parses the tables, checks continuity
counters, reassembles the elementary packets and lists time stamps with their random-access points.

Null and empty payloads are one unit of 64 zero bytes; equal payloads give equal streams. Repeated
rows are kept, extra columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelspark.llm import common  # noqa: F401
from panelspark.session import shared_dir

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID, PRIVATE_STREAM, PRIVATE_TYPE = 188, 0x47, 0x0000, 0xBD, 0x06
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
CLOCK, RATE = 90_000, 8_000
#: Samples of a unit: header (14) and samples fill 16 packets, the first with 8 bytes of adaptation.
UNIT_PACKETS = 16
UNIT = 176 + (UNIT_PACKETS - 1) * 184 - 14
PAD = 64

MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, packets long, units long, continuity_errors long, "
    "points array<struct<pts:long,packet:long>>"
)


def section_crc(data: bytes) -> int:
    """CRC-32 of table sections: most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _table(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    section = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    section += struct.pack(">I", section_crc(section))
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


TABLES = _table(PAT_PID, 0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)) + _table(
    PMT_PID, 0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_TYPE, 0xE000 | ES_PID, 0xF000)
)


def _stamp(pts: int) -> bytes:
    return bytes((
        0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1,
    ))


def _unit_head(pts: int, n: int) -> bytes:
    return b"\x00\x00\x01" + struct.pack(">BHBBB", PRIVATE_STREAM, n + 8, 0x84, 0x80, 5) + _stamp(pts)


def _pcr(pts: int) -> bytes:
    return struct.pack(">Q", (pts << 15) | (0x3F << 9))[2:]


def _ticks(sample: int) -> int:
    return sample * CLOCK // RATE % (1 << 33)


def mux(payload: bytes) -> bytes:
    """Payload -> transport stream; every unit starts with a random-access mark and a time stamp."""
    samples = np.frombuffer(payload, np.uint8)
    full = len(samples) // UNIT
    out = np.empty((full, UNIT_PACKETS, PACKET), np.uint8)
    if full:
        body = np.empty((full, UNIT + 14), np.uint8)
        body[:, 14:] = samples[: full * UNIT].reshape(full, UNIT)
        heads = b"".join(_unit_head(_ticks(i * UNIT), UNIT) for i in range(full))
        body[:, :14] = np.frombuffer(heads, np.uint8).reshape(full, 14)
        out[:, :, 0], out[:, :, 1], out[:, :, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        out[:, :, 3] = 0x10 | np.arange(UNIT_PACKETS)
        out[:, 0, 1] |= 0x40
        out[:, 0, 3] |= 0x20
        out[:, 0, 4], out[:, 0, 5] = 7, 0x50
        clocks = b"".join(_pcr(_ticks(i * UNIT)) for i in range(full))
        out[:, 0, 6:12] = np.frombuffer(clocks, np.uint8).reshape(full, 6)
        out[:, 0, 12:] = body[:, :176]
        out[:, 1:, 4:] = body[:, 176:].reshape(full, UNIT_PACKETS - 1, 184)
    rest = payload[full * UNIT :]
    packets = [TABLES, out.tobytes()]
    if rest:
        pts = _ticks(full * UNIT)
        data, at, k = _unit_head(pts, len(rest)) + rest, 0, 0
        while at < len(data):
            field = b"\x50" + _pcr(pts) if k == 0 else b""
            room = 184 - (len(field) + 1 if field else 0)
            short = room - (len(data) - at)
            if short > 0:
                if field:
                    field += b"\xff" * short
                elif short > 1:
                    field = b"\x00" + b"\xff" * (short - 2)
            head = bytes([SYNC, 0x40 * (k == 0) | ES_PID >> 8, ES_PID & 0xFF, (0x30 if field or short > 0 else 0x10) | k % 16])
            if field or short > 0:
                head += bytes([len(field)]) + field
            take = PACKET - len(head)
            packets.append(head + data[at : at + take])
            at, k = at + take, k + 1
    return b"".join(packets)


def _sections(packets: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> bytes:
    for row in packets[(pid == wanted) & (packets[:, 1] & 0x40 > 0)]:
        data = row[5 + row[4] :].tobytes()
        size = 3 + (struct.unpack(">H", data[1:3])[0] & 0x0FFF)
        if data[0] == table_id and section_crc(data[:size]) == 0:
            return data[:size]
    raise ValueError(f"no valid table {table_id} on packet id {wanted}")


def demux(media: bytes) -> dict:
    """Transport stream -> payload, time stamps with packets of random access, continuity errors.

    A stream without valid tables raises ``ValueError``; so does a unit whose stated length differs.
    """
    if len(media) % PACKET:
        raise ValueError("the stream is not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("a packet does not begin with the sync byte")
    pid = ((p[:, 1].astype(np.int32) & 0x1F) << 8) | p[:, 2]
    program, pmt_pid = struct.unpack(">HH", _sections(p, pid, PAT_PID, 0x00)[8:12])
    pmt = _sections(p, pid, pmt_pid & 0x1FFF, 0x02)
    info = struct.unpack(">H", pmt[10:12])[0] & 0x0FFF
    kind, es_pid = struct.unpack(">BH", pmt[12 + info : 15 + info])
    at = np.flatnonzero(pid == (es_pid & 0x1FFF))
    es = p[at]
    begins = es[:, 1] & 0x40 > 0
    adapted = es[:, 3] & 0x20 > 0
    counter = es[:, 3] & 0x0F
    carries = es[:, 3] & 0x10 > 0
    wanted = (counter[:-1] + carries[1:]) & 0x0F
    errors = int((counter[1:] != wanted).sum())
    start = 4 + np.where(adapted, es[:, 4].astype(np.int32) + 1, 0)
    access = adapted & (es[:, 4] > 0) & (es[:, 5] & 0x40 > 0)
    heads = np.flatnonzero(begins)
    fixed = es[heads[:, None], start[heads, None] + np.arange(14)].astype(np.int64)
    if len(heads) and ((fixed[:, 0] != 0) | (fixed[:, 1] != 0) | (fixed[:, 2] != 1)).any():
        raise ValueError("a unit does not begin with its start code")
    stamps = (
        ((fixed[:, 9] & 0x0E) << 29) | (fixed[:, 10] << 22) | ((fixed[:, 11] & 0xFE) << 14) | (fixed[:, 12] << 7) | (fixed[:, 13] >> 1)
    )
    body = start.copy()
    body[heads] += 9 + fixed[:, 8].astype(np.int32)
    sizes = np.add.reduceat(PACKET - body, heads) if len(heads) else np.empty(0, np.int64)
    if (sizes != (fixed[:, 4] << 8 | fixed[:, 5]) - 3 - fixed[:, 8]).any():
        raise ValueError("a unit has another length than it states")
    return {
        "program": program, "stream_type": kind, "es_pid": es_pid & 0x1FFF, "payload": es[np.arange(PACKET) >= body[:, None]].tobytes(),
        "pts": stamps, "packet": at[heads], "access": access[heads], "packets": len(p), "continuity_errors": errors,
    }


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % PAD or (0 if data else PAD))


def _mux_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    for batch in batches:
        for part in common.text_slices(batch, "text"):
            raw = [(t or "").encode() for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), [len(t) for t in raw], [mux(padded(t)) for t in raw]], schema=schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One transport stream per row over its padded UTF-8 text (null: empty): doc_id, n_bytes, media."""
    pair = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return pair.mapInArrow(_mux_rows, MEDIA_SCHEMA)


def _demux_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    point = pa.struct([("pts", pa.int64()), ("packet", pa.int64())])
    fields = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature packets units continuity_errors"
    text = {"payload_sha256", "media_sha256", "feature"}
    schema = pa.schema([(n, pa.string() if n in text else pa.int64()) for n in fields.split()] + [("points", pa.list_(point))])
    for batch in batches:
        for part in common.text_slices(batch, "media"):
            rows = []
            for doc_id, n_bytes, media in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                s = demux(media)
                data = s["payload"]
                counts = np.bincount(np.frombuffer(data[:n_bytes], np.uint8) >> 5, minlength=8)
                feature = (
                    f"program={s['program']};type={s['stream_type']};pid={s['es_pid']};packets={s['packets']};units={len(s['pts'])};"
                    f"access={int(s['access'].sum())};lost={s['continuity_errors']};last_pts={int(s['pts'][-1])};"
                    f"levels={','.join(map(str, counts))}"
                )
                points = [{"pts": int(t), "packet": int(k)} for t, k, a in zip(s["pts"], s["packet"], s["access"]) if a]
                rows.append((
                    doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(media),
                    hashlib.sha256(media).hexdigest(), feature, s["packets"], len(s["pts"]), s["continuity_errors"], points,
                ))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def features(media: DataFrame) -> DataFrame:
    """Demultiplexes stored streams and describes what was read back, one row per stream."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_demux_rows, FEATURE_SCHEMA)


def store(media: DataFrame, path: str | None = None) -> DataFrame:
    """Writes streams to Parquet (default: a new table in the shared folder) and returns the stored table."""
    import uuid

    spark = media.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    media.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(media.schema).parquet(path)
