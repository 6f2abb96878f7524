"""BAM files as a Spark data source, read by splits and written in sorted parts; .bai indexes.

A split takes the records that begin in its blocks.  Where a split begins is not where a record does, so
its first record is the first place from which several records in a row make sense: lengths that add
up, contigs that exist, names that end, CIGARs of known operations.  Parts that are written are BAM files of their
own, in the order of the whole; ``merged`` puts them into one file, block by block as they are.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from haplospark.operators import alignment, realign
from haplospark.sources import bgzf, sam

NAME = "haplospark_bam"
SPLIT = 64 << 20
ROWS = 8192
#: Codes of bases and of operations, by place. Fixed values of the format.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_TO_BASES = str.maketrans("0123456789abcdef", BASES)
_FROM_BASES = {c: "0123456789abcdef"[i] for i, c in enumerate(BASES)}
_FROM_BASES = str.maketrans({**_FROM_BASES, **{c.lower(): v for c, v in _FROM_BASES.items()}})
_TO_QUALITY, _FROM_QUALITY = bytes(min(i + 33, 255) for i in range(256)), bytes(max(i - 33, 0) for i in range(256))
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_FIXED = struct.Struct("<iiBBHHHiiii")
#: Records in a row that must make sense where a split begins.
IN_A_ROW = 4
_MAP = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([
    ("qname", pa.string()), ("flag", pa.int32()), ("tid", pa.int32()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string()),
    ("mate_tid", pa.int32()), ("mate_pos", pa.int32()), ("tlen", pa.int32()), ("xg", pa.string()), ("op", pa.int32()), ("oc", pa.string()), ("tags", _MAP),
])


# Records.


@lru_cache(1 << 16)
def _cigar(packed: bytes) -> str:
    return "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack(f"<{len(packed) // 4}I", packed))


def _tags(data: bytes, at: int) -> list[tuple[str, str]]:
    """Tags as text: their names, and type and value as in SAM. Of a repeated tag the first one stays."""
    out: dict[str, str] = {}
    while at < len(data):
        name, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = f"A:{chr(data[at])}", at + 1
        elif kind in _NUMBERS:
            (x,) = struct.unpack_from("<" + _NUMBERS[kind], data, at)
            value, at = (f"f:{x:.9g}" if kind == "f" else f"i:{x}"), at + struct.calcsize(_NUMBERS[kind])
        elif kind in "ZH":
            stop = data.index(0, at)
            value, at = f"{kind}:{data[at:stop].decode('utf-8', 'replace')}", stop + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            numbers = struct.unpack_from(f"<{n}{_NUMBERS[sub]}", data, at + 5)
            value, at = ",".join([f"B:{sub}", *(f"{x:.9g}" if sub == "f" else str(x) for x in numbers)]), at + 5 + n * struct.calcsize(_NUMBERS[sub])
        else:
            raise ValueError(f"a tag has the unknown type {kind!r}")
        out.setdefault(name, value)
    return list(out.items())


def decoded(data: bytes) -> tuple:
    """A record, without its length in front, as the columns of _ARROW."""
    tid, pos, n_name, mapq, _, n_ops, flag, n_bases, mate_tid, mate_pos, tlen = _FIXED.unpack_from(data)
    at = 32 + n_name
    name, ops = data[32 : at - 1].decode("latin-1"), _cigar(data[at : at + 4 * n_ops])
    at += 4 * n_ops
    half = (n_bases + 1) // 2
    seq, qual = data[at : at + half].hex().translate(_TO_BASES)[:n_bases], data[at + half : at + half + n_bases]
    tags = dict(_tags(data, at + half + n_bases))
    if "CG" in tags and ops.startswith(f"{n_bases}S"):  # more operations than the record's own field can count
        ops = _cigar(struct.pack(f"<{tags['CG'].count(',')}I", *map(int, tags.pop("CG").split(",")[1:])))
    special = {k: tags.pop(k, "  ")[2:] or None for k in ("XG", "OP", "OC")}
    known = lambda x: x if x >= 0 else None
    return (
        name if name != "*" else None, flag, known(tid), known(pos), mapq, ops or None, seq or None, qual.translate(_TO_QUALITY).decode("latin-1") if qual and qual[0] != 255 else None,
        known(mate_tid), known(mate_pos), tlen, special["XG"], int(special["OP"]) if special["OP"] else None, special["OC"], list(tags.items()),
    )


def _tag(name: str, text: str) -> bytes:
    kind, value = text[0], text[2:]
    head = name.encode("latin-1")
    if kind == "A":
        return head + b"A" + value.encode("latin-1")[:1]
    if kind == "i":
        x = int(value)
        return head + (b"i" + struct.pack("<i", x) if -(1 << 31) <= x < 1 << 31 else b"I" + struct.pack("<I", x))
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind in "ZH":
        return head + kind.encode() + value.encode() + b"\0"
    if kind == "B":
        sub, *numbers = value.split(",")
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(numbers)}{_NUMBERS[sub]}", len(numbers), *map(float if sub == "f" else int, numbers))
    raise ValueError(f"a tag has the unknown type {kind!r}")


def _bin(start: int, stop: int) -> int:
    """The smallest bin of the index that holds a range: bins of 2^14 bases, and of 8 times as many on each level above."""
    for level in range(5, 0, -1):
        shift = 29 - 3 * level
        if start >> shift == stop - 1 >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def encoded(row: dict) -> bytes:
    """A record with its length in front."""
    ops = alignment.operations(row.get("cigar") or "")
    bases, qual = row.get("seq") or "", row.get("qual")
    tags = dict(row.get("tags") or ())
    tags |= {k: v for k, v in (("XG", row.get("xg") and f"Z:{row['xg']}"), ("OP", row["op"] is not None and f"i:{row['op']}" if "op" in row else None), ("OC", row.get("oc") and f"Z:{row['oc']}")) if v}
    packed = struct.pack(f"<{len(ops)}I", *(n << 4 | OPERATIONS.index(op) for n, op in ops))
    span = sum(n for n, op in ops if op in alignment.REFERENCE)
    if len(ops) > 0xFFFF:
        tags["CG"] = ",".join(["B:I", *(str(x) for x in struct.unpack(f"<{len(ops)}I", packed))])
        packed = struct.pack("<II", len(bases) << 4 | 4, span << 4 | 3)
    known = lambda c, none: none if row.get(c) is None else row[c]
    pos, name = known("pos", -1), (row.get("qname") or "*").encode("latin-1", "replace")[:254] + b"\0"
    # A base that has no code is written as N.
    digits = "".join(c if c in "0123456789abcdef" else "f" for c in bases.translate(_FROM_BASES)) if bases else ""
    quality = qual.encode("latin-1", "replace").translate(_FROM_QUALITY) if qual and len(qual) == len(bases) else b"\xff" * len(bases)
    body = _FIXED.pack(known("tid", -1), pos, len(name), known("mapq", 0), _bin(max(pos, 0), max(pos, 0) + max(span, 1)), len(packed) // 4, known("flag", 0), len(bases), known("mate_tid", -1), known("mate_pos", -1), known("tlen", 0))
    body += name + packed + bytes.fromhex(digits + "0" * (len(digits) % 2)) + quality + b"".join(_tag(k, v) for k, v in tags.items())
    return struct.pack("<i", len(body)) + body


def header_bytes(lines: Sequence[str]) -> bytes:
    """The start of a BAM file: the header's text, and the contigs that its @SQ lines name."""
    text = "".join(f"{x}\n" for x in lines).encode()
    out = [b"BAM\1", struct.pack("<i", len(text)), text]
    contigs = sam.contigs_of(lines)
    out.append(struct.pack("<i", len(contigs)))
    for name, length in contigs:
        raw = name.encode() + b"\0"
        out += [struct.pack("<i", len(raw)), raw, struct.pack("<i", length)]
    return b"".join(out)


def read_header(path: str) -> tuple[list[str], list[tuple[str, int]], tuple[int, int]]:
    """The header's lines, the contigs' names and lengths, and where the first record is (block, place in it), of the first file."""
    found = bgzf.files(path, ".bam")
    if not found:
        raise FileNotFoundError(f"no BAM file in {path}")
    with bgzf.opened(found[0][0]) as f:
        data = bgzf.Bytes(f, 0)
        if data.take(4) != b"BAM\1":
            raise ValueError(f"{found[0][0]} is not a BAM file")
        number = lambda: struct.unpack("<i", data.take(4))[0]
        lines = data.take(number()).decode().rstrip("\0").splitlines()
        contigs = [(data.take(number())[:-1].decode(), number()) for _ in range(number())]
        return lines, contigs, data.place()


def _sensible(data: bytes, at: int, lengths: list[int]) -> int:
    """Where the record that may begin at a place would end; 0 if what is there can't be one, -1 if the bytes don't suffice to tell."""
    if len(data) < at + 36:
        return -1
    size, tid, pos, n_name, _, _, n_ops, _, n_bases, mate_tid, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (0 <= n_bases <= size and n_name and size >= 32 + n_name + 4 * n_ops + (n_bases + 1) // 2 + n_bases):
        return 0
    for contig, place in ((tid, pos), (mate_tid, mate_pos)):
        if not -1 <= contig < len(lengths) or place < -1 or (contig >= 0 and place > lengths[contig]):
            return 0
    name = data[at + 36 : at + 36 + n_name]
    if len(name) < n_name:
        return -1
    if name[-1] or any(not 32 < c < 127 for c in name[:-1]):
        return 0
    ops = data[at + 36 + n_name : at + 36 + n_name + 4 * n_ops]
    if any(x & 15 >= len(OPERATIONS) for x in ops[: len(ops) // 4 * 4 : 4]):
        return 0
    return at + 4 + size


def _first_record(source: bgzf.Bytes, lengths: list[int]) -> bool:
    """Moves to the first record; False if there is none."""
    at = 0
    while True:
        while at + 36 > len(source.data):
            if not source.more():
                return False
        end, seen = at, 0
        while seen < IN_A_ROW:
            then = _sensible(source.data, end, lengths)
            if then == 0:
                break
            if then < 0 or then > len(source.data):
                if source.more():
                    continue
                # The file's last records end where it does.
                seen = IN_A_ROW if seen and end == len(source.data) or then == len(source.data) else seen
                break
            end, seen = then, seen + 1
            if end == len(source.data) and not source.more():
                seen = IN_A_ROW
        if seen >= IN_A_ROW:
            source.at = at
            return True
        at += 1


# The data source.


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    skip: int  # where in its first block the first record is; -1: that is to be found
    end: int
    size: int

    def __init__(self, path: str, begin: int, skip: int, end: int, size: int):
        super().__init__(None)
        self.path, self.begin, self.skip, self.end, self.size = path, begin, skip, end, size


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.lengths = [n for _, n in read_header(path)[1]]

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path, size in bgzf.files(self.path, ".bam"):
            first, skip = read_header(path)[2]
            out.append(Split(path, first, skip, max(first + 1, self.split), size))
            out += [Split(path, lo, -1, lo + self.split, size) for lo in range(max(first + 1, self.split), size, self.split)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        with bgzf.opened(split.path) as f:
            begin = split.begin if split.skip >= 0 else bgzf.first_block(f, split.begin, split.size)
            if begin >= min(split.end, split.size):
                return
            source = bgzf.Bytes(f, begin, max(split.skip, 0))
            if split.skip < 0 and not _first_record(source, self.lengths):
                return
            rows = []
            while source.has(4) and source.place()[0] < split.end:
                rows.append(decoded(source.take(struct.unpack("<i", source.take(4))[0])))
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceArrowWriter):
    """A file and its index for each task, below a folder of the job's own until all have ended."""

    def __init__(self, path: str, lines: list[str], index: bool, overwrite: bool):
        self.path, self.lines, self.index, self.overwrite = path.rstrip("/"), lines, index, overwrite
        self.folder = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, folder = bgzf.located(self.folder)
        fs.create_dir(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.bam"
        index = Index(len(sam.contigs_of(self.lines)))
        any_rows = False
        with fs.open_output_stream(f"{folder}/{name}") as f:
            out = _Output(f)
            out.put(header_bytes(self.lines))
            out.flush()
            for batch in iterator:
                for row in batch.to_pylist():
                    any_rows = True
                    begin = out.place()
                    out.put(encoded(row))
                    index.add(row, begin, out.place())
            out.flush()
            f.write(bgzf.END)
        if not any_rows and context.partitionId():
            return Written(None)
        if self.index:
            with fs.open_output_stream(f"{folder}/{name}.bai") as f:
                f.write(index.packed())
        return Written(name)

    def commit(self, messages: list) -> None:
        fs, path = bgzf.located(self.path)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(path)):
                if old.is_file and old.path.endswith((".bam", ".bai")):
                    fs.delete_file(old.path)
        folder = bgzf.located(self.folder)[1]
        for m in messages:
            if m is not None and m.name:
                whole = m.name[: len("part-00000")] + ".bam"
                fs.move(f"{folder}/{m.name}", f"{path}/{whole}")
                if self.index:
                    fs.move(f"{folder}/{m.name}.bai", f"{path}/{whole}.bai")
        fs.delete_dir(folder)

    def abort(self, messages: list) -> None:
        fs, folder = bgzf.located(self.folder)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class _Output:
    """Bytes on their way into blocks."""

    def __init__(self, f):
        self.f, self.written, self.held = f, 0, b""

    def put(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= bgzf.PAYLOAD:
            self._block(bgzf.PAYLOAD)

    def flush(self) -> None:
        if self.held:
            self._block(len(self.held))

    def _block(self, n: int) -> None:
        packed = bgzf.block(self.held[:n])
        self.f.write(packed)
        self.written, self.held = self.written + len(packed), self.held[n:]

    def place(self) -> int:
        """The next byte's virtual offset: its block's place and its own place in the block's content."""
        return self.written << 16 | len(self.held)


class BamSource(DataSource):
    """Options: path; splitBytes of a read; header (text) and index of a write."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return sam.SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options["header"].splitlines(), self.options.get("index", "false") == "true", overwrite)


# Indexes.


class Index:
    """The bins and windows of a .bai file: where in the file the records of a range of a contig lie."""

    WINDOW = 14

    def __init__(self, n_contigs: int):
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in range(n_contigs)]
        self.windows: list[dict[int, int]] = [{} for _ in range(n_contigs)]

    def add(self, row: dict, begin: int, end: int) -> None:
        tid, pos = row.get("tid"), row.get("pos")
        if tid is None or pos is None or not 0 <= tid < len(self.bins):
            return
        span = max(1, sum(n for n, op in alignment.operations(row.get("cigar") or "") if op in alignment.REFERENCE))
        chunks = self.bins[tid].setdefault(_bin(pos, pos + span), [])
        if chunks and chunks[-1][1] >> 16 == begin >> 16:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        for w in range(pos >> self.WINDOW, (pos + span - 1 >> self.WINDOW) + 1):
            self.windows[tid].setdefault(w, begin)

    def join(self, other: Index, by: int) -> None:
        """Adds the index of what is put into the file behind, *by* bytes further than it was."""
        for tid, bins in enumerate(other.bins):
            for b, chunks in bins.items():
                self.bins[tid].setdefault(b, []).extend([x + (by << 16), y + (by << 16)] for x, y in chunks)
            for w, at in other.windows[tid].items():
                self.windows[tid].setdefault(w, at + (by << 16))

    def packed(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for bins, windows in zip(self.bins, self.windows):
            out.append(struct.pack("<i", len(bins)))
            for b in sorted(bins):
                out.append(struct.pack("<Ii", b, len(bins[b])))
                out += [struct.pack("<QQ", *chunk) for chunk in bins[b]]
            n, last = max(windows, default=-1) + 1, 0
            out.append(struct.pack("<i", n))
            for w in range(n):
                last = windows.get(w, last)
                out.append(struct.pack("<Q", last))
        return b"".join(out)

    @classmethod
    def unpacked(cls, data: bytes) -> Index:
        if data[:4] != b"BAI\1":
            raise ValueError("this is not an index")
        out, at = cls(struct.unpack_from("<i", data, 4)[0]), 8
        for tid in range(len(out.bins)):
            (n,) = struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(n):
                b, chunks = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * chunks}Q", data, at + 8)
                out.bins[tid][b] = [[*x] for x in zip(flat[::2], flat[1::2])]
                at += 8 + 16 * chunks
            (n,) = struct.unpack_from("<i", data, at)
            windows = struct.unpack_from(f"<{n}Q", data, at + 4)
            at += 4 + 8 * n
            out.windows[tid] = {w: x for w, x in enumerate(windows) if x}
        return out


# What callers use.


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """tid, name, length."""
    contigs = read_header(path)[1]
    return spark.createDataFrame([(i, name, n) for i, (name, n) in enumerate(contigs)], "tid int, name string, length int")


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """The records of a BAM file, or of all of a directory, whose headers name the same contigs; columns as sam.read gives them."""
    register(spark)
    return spark.read.format(NAME).option("splitBytes", str(split_bytes)).load(path)


def write(reads: DataFrame, path: str, header: list[str], index: bool = False) -> None:
    """A directory of BAM files in coordinate order, one for each task; index: with a .bai file beside each."""
    register(reads.sparkSession)
    ordered = realign.coordinate_sorted(reads).drop("endpos")
    columns = [f.name for f in _ARROW if f.name in ordered.columns]
    ordered.select(*columns).write.format(NAME).option("header", "\n".join(header)).option("index", str(index).lower()).mode("overwrite").save(path)


def merged(folder: str, path: str, index: bool = False) -> None:
    """One BAM file of a directory's parts, in their order, streamed by the driver; index: with its .bai file, from those of the parts."""
    parts = bgzf.files(folder, ".bam")
    fs, target = bgzf.located(path)
    whole: Index | None = None
    at = 0
    with fs.open_output_stream(target) as out:
        for i, (part, size) in enumerate(parts):
            begin = read_header(part)[2][0]  # the writer ends the header's block before the first record
            with bgzf.opened(part) as f:
                lo = 0 if i == 0 else begin
                f.seek(lo)
                left = size - len(bgzf.END) - lo
                if index:
                    with bgzf.opened(f"{part}.bai") as bai:
                        own = Index.unpacked(bai.read())
                    whole = whole or Index(len(own.bins))
                    whole.join(own, at - lo)
                at += left
                while left:
                    data = f.read(min(left, 8 << 20))
                    out.write(data)
                    left -= len(data)
        out.write(bgzf.END)
    if index and whole:
        with fs.open_output_stream(f"{target}.bai") as f:
            f.write(whole.packed())
