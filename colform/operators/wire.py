"""Self-describing packets for single values: tagged bytes with prefix varints and a bounds-checked reader.

Layout: version byte, flag byte (bit 0: strings are interned, bit 2: fractional numbers are kept exact), then one tagged value. Whole numbers
take their narrowest form, integers from 2^53 on 64 bits; a string that came before is its number; arrays and maps are a count and their values; map keys
are any values. Packets made elsewhere may be hostile: every count is held against the bytes that are left, and depth is limited.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from colform.options import EncodeOptions

VERSION = 1
#: Fixed values of the format.
NIL, TRUE, FALSE, NAN, INF, NEG_INF, NEG_ZERO = range(0x00, 0x07)
SMALL = 0x10
U8, U16, U32, I8, I16, I32, F32, F64, VARINT, NEG_VARINT, I64 = range(0x30, 0x3B)
STRING, STRING_REF, BUFFER = 0x40, 0x41, 0x42
ARRAY, MAP = 0x50, 0x51
_FIXED = {U8: "<B", U16: "<H", U32: "<I", I8: "<b", I16: "<h", I32: "<i", F32: "<f", F64: "<d", I64: "<q"}


class PacketError(ValueError):
    pass


class Writer:
    def __init__(self) -> None:
        self.out = bytearray()
        self.strings: dict[str, int] = {}

    def varint(self, x: int) -> None:
        """1 byte to 191, 2 to 8383, 3 to 1056959, then a marker with 4 or 8 bytes."""
        if x < 0 or x >= 2**53:
            raise ValueError("varints are whole numbers below 2^53")
        if x <= 191:
            self.out.append(x)
        elif x <= 8383:
            x -= 192
            self.out += bytes((192 + (x >> 8), x & 255))
        elif x <= 1056959:
            x -= 8384
            self.out += bytes((224 + (x >> 16), x >> 8 & 255, x & 255))
        elif x < 2**32:
            self.out += b"\xfe" + struct.pack("<I", x)
        else:
            self.out += b"\xff" + struct.pack("<Q", x)

    def number(self, x: float) -> None:
        if x != x:
            self.out.append(NAN)
        elif x in (float("inf"), float("-inf")):
            self.out.append(INF if x > 0 else NEG_INF)
        elif x == 0 and str(float(x))[0] == "-":
            self.out.append(NEG_ZERO)
        elif x == int(x) and abs(x) < 2**53:
            x = int(x)
            if 0 <= x <= 31:
                self.out.append(SMALL + x)
                return
            ranges = ((U8, 0, 255), (U16, 0, 65535), (U32, 0, 2**32 - 1), (I8, -128, -1), (I16, -32768, -1), (I32, -(2**31), -1))
            tag = next((t for t, low, high in ranges if low <= x <= high), VARINT if x > 0 else NEG_VARINT)
            self.out.append(tag)
            if tag in _FIXED:
                self.out += struct.pack(_FIXED[tag], x)
            else:
                self.varint(abs(x))
        elif isinstance(x, int):
            if not -(2**63) <= x < 2**63:
                raise ValueError("whole numbers have at most 64 bits")
            self.out.append(I64)
            self.out += struct.pack("<q", x)
        else:
            try:
                short = struct.unpack("<f", struct.pack("<f", x))[0] == x
            except OverflowError:
                short = False
            tag = F32 if short else F64
            self.out.append(tag)
            self.out += struct.pack(_FIXED[tag], x)

    def value(self, v, depth: int) -> None:
        if depth < 0:
            raise ValueError("value is nested too deeply")
        if v is None:
            self.out.append(NIL)
        elif isinstance(v, bool):
            self.out.append(TRUE if v else FALSE)
        elif isinstance(v, (int, float)):
            self.number(v)
        elif isinstance(v, str):
            if v in self.strings:
                self.out.append(STRING_REF)
                self.varint(self.strings[v])
            else:
                self.strings[v] = len(self.strings)
                raw = v.encode()
                self.out.append(STRING)
                self.varint(len(raw))
                self.out += raw
        elif isinstance(v, (bytes, bytearray)):
            self.out.append(BUFFER)
            self.varint(len(v))
            self.out += v
        elif isinstance(v, (list, tuple)):
            self.out.append(ARRAY)
            self.varint(len(v))
            for x in v:
                self.value(x, depth - 1)
        elif isinstance(v, dict):
            self.out.append(MAP)
            self.varint(len(v))
            for k, x in v.items():
                self.value(k, depth - 1)
                self.value(x, depth - 1)
        else:
            raise TypeError(f"a {type(v).__name__} cannot be serialized")


class Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = bytes(raw), 0
        self.strings: list[str] = []

    def take(self, n: int) -> bytes:
        if n > len(self.raw) - self.at:
            raise PacketError("packet ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def varint(self) -> int:
        first = self.take(1)[0]
        if first <= 191:
            return first
        if first < 224:
            return 192 + ((first - 192) << 8 | self.take(1)[0])
        if first < 0xFE:
            a, b = self.take(2)
            return 8384 + ((first - 224) << 16 | a << 8 | b)
        x = struct.unpack("<I" if first == 0xFE else "<Q", self.take(4 if first == 0xFE else 8))[0]
        if x >= 2**53:
            raise PacketError("varint is too large")
        return x

    def count(self, bytes_each: int) -> int:
        n = self.varint()
        if n * bytes_each > len(self.raw) - self.at:
            raise PacketError("count exceeds the bytes that are left")
        return n

    def value(self, depth: int):
        if depth < 0:
            raise PacketError("packet is nested too deeply")
        tag = self.take(1)[0]
        if tag <= NEG_ZERO:
            return (None, True, False, float("nan"), float("inf"), float("-inf"), -0.0)[tag]
        if SMALL <= tag < SMALL + 32:
            return tag - SMALL
        if tag in _FIXED:
            form = _FIXED[tag]
            return struct.unpack(form, self.take(struct.calcsize(form)))[0]
        if tag in (VARINT, NEG_VARINT):
            return self.varint() if tag == VARINT else -self.varint()
        if tag == STRING:
            try:
                text = self.take(self.count(1)).decode()
            except UnicodeDecodeError as bad:
                raise PacketError("string is not UTF-8") from bad
            self.strings.append(text)
            return text
        if tag == STRING_REF:
            n = self.varint()
            if n >= len(self.strings):
                raise PacketError("reference to no string")
            return self.strings[n]
        if tag == BUFFER:
            return self.take(self.count(1))
        if tag == ARRAY:
            return [self.value(depth - 1) for _ in range(self.count(1))]
        if tag == MAP:
            out = {}
            for _ in range(self.count(2)):
                k = self.value(depth - 1)
                if isinstance(k, (list, dict)):
                    raise PacketError("a map key is a table")
                out[k] = self.value(depth - 1)
            return out
        raise PacketError(f"unknown tag {tag:#x}")


def serialize(value, max_depth: int = 512) -> bytes:
    w = Writer()
    w.out += bytes((VERSION, 5))
    w.value(value, max_depth)
    return bytes(w.out)


def deserialize(packet: bytes, max_depth: int = 512):
    r = Reader(packet)
    if r.take(1)[0] != VERSION:
        raise PacketError("unknown packet version")
    r.take(1)
    value = r.value(max_depth)
    if r.at != len(r.raw):
        raise PacketError("bytes behind the value")
    return value


def to_text(value, max_depth: int = 512) -> str:
    """A packet as text."""
    return base64.b64encode(serialize(value, max_depth)).decode()


def from_text(text: str, max_depth: int = 512):
    try:
        packet = base64.b64decode(text, validate=True)
    except ValueError as bad:
        raise PacketError("text is not base64") from bad
    return deserialize(packet, max_depth)


def pack_rows(df: DataFrame, columns: list[str], name: str = "packet", options: EncodeOptions = EncodeOptions()) -> DataFrame:
    """Adds a packet of the row's fields as a map, nested at most ``options.max_depth`` deep. Fields come through Arrow, so that missing values, NaN and 64-bit numbers stay what they are."""
    schema = StructType([*df.schema.fields, StructField(name, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packets = pa.array([serialize(r, options.max_depth) for r in batch.select(columns).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packets], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def unpack_rows(df: DataFrame, fields: StructType | str, name: str = "packet") -> DataFrame:
    """The fields of ``pack_rows`` packets; a whole number of a fractional column becomes one again."""
    schema = df.sparkSession.createDataFrame([], fields).schema if isinstance(fields, str) else fields
    types = to_arrow_schema(schema)

    def column(rows: list[dict], field: pa.Field) -> pa.Array:
        values = [r.get(field.name) for r in rows]
        if pa.types.is_floating(field.type):
            values = [None if v is None else float(v) for v in values]
        return pa.array(values, field.type, from_pandas=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [deserialize(p.as_py()) for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([column(rows, f) for f in types], names=types.names)

    return df.select(name).mapInArrow(run, schema)
