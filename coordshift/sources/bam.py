"""Reader of BAM files. A file is one task, decompressed block by block; Spark gives files of up to 2 GB whole, larger ones are cut by contig first."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Letters of operators and nucleotide codes, and sizes of tag values, in the format's order (fixed values).
OPERATORS, CODES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SIZES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_TAG = pa.struct([("type", pa.string()), ("value", pa.string())])
_FIELDS = [("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("rnext", pa.string()), ("pnext", pa.int64()), ("tlen", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), _TAG))]
SCHEMA = pa.schema(_FIELDS)
_DDL = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,struct<type:string,value:string>>"


def inflated(data: bytes, most: int = 1 << 22) -> Iterator[bytes]:
    """The text of concatenated gzip members, in pieces."""
    at = 0
    while at < len(data):
        member = zlib.decompressobj(wbits=31)
        while not member.eof and at < len(data):
            piece = data[at : at + most]
            yield member.decompress(piece)
            at += len(piece) - len(member.unused_data)


class Stream:
    """Bytes on demand."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            piece = next(self.pieces, None)
            if piece is None:
                return b""
            self.held, self.at = self.held[self.at :] + piece, 0
        self.at += n
        return self.held[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def heading(stream: Stream) -> tuple[str, list[str]]:
    """The header's text and the contigs' names."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.take(stream.number()).rstrip(b"\0").decode()
    names = []
    for _ in range(stream.number()):
        names.append(stream.take(stream.number())[:-1].decode())
        stream.number()
    return text, names


def tags_of(raw: bytes) -> list[tuple[str, dict[str, str]]]:
    out, at = [], 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            value, at = raw[at:end].decode(), end + 1
        elif kind == "B":
            inner, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            form = f"<{n}{SIZES[inner]}"
            value = ",".join([inner, *(f"{x:g}" if inner == "f" else str(x) for x in struct.unpack_from(form, raw, at + 5))])
            kind, at = "B", at + 5 + struct.calcsize(form)
        else:
            x = struct.unpack_from("<" + SIZES[kind], raw, at)[0]
            at += struct.calcsize("<" + SIZES[kind])
            value = x.decode() if kind == "A" else f"{x:g}" if kind == "f" else str(x)
            kind = kind if kind in "Af" else "i"
        out.append((name, {"type": kind, "value": value}))
    return out


def record(raw: bytes, names: list[str]) -> tuple:
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + l_name
    cigar = struct.unpack_from(f"<{n_cigar}I", raw, at)
    at += 4 * n_cigar
    seq = "".join(CODES[b >> 4] + CODES[b & 15] for b in raw[at : at + (l_seq + 1) // 2])[:l_seq]
    at += (l_seq + 1) // 2
    qual = raw[at : at + l_seq]
    contig = lambda i: names[i] if i >= 0 else "*"
    rnext = "=" if next_ref == ref and ref >= 0 else contig(next_ref)
    quality = "*" if not l_seq or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    return (raw[32 : 32 + l_name - 1].decode(), flag, contig(ref), pos, mapq, "".join(f"{c >> 4}{OPERATORS[c & 15]}" for c in cigar) or "*", rnext, next_pos, tlen, seq or "*", quality, tags_of(raw[at + l_seq :]))


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Records with the columns of ``sources.text.read_sam``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                stream = Stream(inflated(content.as_buffer().to_pybytes()))
                _, names = heading(stream)
                held = []
                while size := stream.take(4):
                    held.append(record(stream.take(struct.unpack("<i", size)[0]), names))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _FIELDS, strict=True)], schema=SCHEMA)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _FIELDS, strict=True)], schema=SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _DDL)


def read_bam_header(spark: SparkSession, path: str) -> list[str]:
    """The header lines of one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                text, _ = heading(Stream(inflated(content.as_buffer().to_pybytes())))
                yield pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string").first()["value"].splitlines()
