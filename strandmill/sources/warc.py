"""Web-archive records.

The JVM text reader cuts the archives (gunzipping ``.gz`` files as a stream) at a line
end followed by ``WARC/``; a generator then takes each record's header and exactly as
many bytes as its Content-Length says. A payload that holds the separator is put back
together from its pieces. Only one record is held in memory at a time.

A split of a plain file is parsed as if a record began at its first mark. One scan writes the records
and a row about the end of every split; the edges of the splits are then settled from these rows. Where a record ends
in a later split, the splits that it reaches into are parsed again from where it ends.

Large ``.gz`` archives are cut at the start of their members (an archive has one for each record), so that their splits are
inflated by many tasks. Where members and records do not go together, one task reads the file as a stream.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import chain
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill import schemas
from strandmill.session import fresh_dir
from strandmill.sources.lines import Paths, read_pieces, small_per_split, write_lines

MARK = b"WARC/"
SEPARATOR = "\nWARC/"

# Header keys that have a field of their own.
FIELD_KEYS = {
    "WARC-Type": "record_type",
    "WARC-Date": "warc_date",
    "WARC-Record-ID": "record_id",
    "Content-Type": "content_type",
}
LENGTH_KEY = "Content-Length"
KNOWN_KEYS = (*FIELD_KEYS, LENGTH_KEY)
VERSION_LINE = "WARC/0.18"

HEADER_LINE = re.compile(rb"([^\n]*)\n")
BATCH_BYTES = 8 << 20

# Fixed value: how a member of a gzip file begins.
MEMBER = b"\x1f\x8b\x08"
PACKED, CHUNK = 64 << 10, 1 << 20  # of a member and of its content, inflated at once
LARGE_GZIP = 32 << 20
# No codec takes a file for which the last ending before its name, in the order of reversed names, is not its own; text
# files without a codec are split. The second name of an option is its name in Spark's shaded client.
UNPACKED = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    "io.compress.passthrough.extension": ".!.gz",
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".!.gz",
    "encoding": "ISO-8859-1",
}


def _read_header(data: bytes) -> tuple[list[bytes], int, int] | None:
    """Header lines, Content-Length and payload offset; None while the header is open.

    The header ends at the first blank line after a Content-Length.
    """
    lines: list[bytes] = []
    length = -1
    version = HEADER_LINE.match(data)
    at = version.end() if version else len(data)
    while found := HEADER_LINE.match(data, at):
        at = found.end()
        line = found.group(1).strip()
        if not line:
            if length >= 0:
                return lines, length, at
            continue
        lines.append(line)
        key, colon, value = line.partition(b":")
        if colon and key == LENGTH_KEY.encode():
            length = int(value) if re.fullmatch(rb"\s*[+-]?\d+\s*", value) else -1
    return None


def _as_row(lines: list[bytes], content: bytes, missing: int | None = None, of_header: int = 0) -> dict:
    """A record; ``missing`` is the number of bytes that a record at the end lacks, -1 if its header is open.

    ``of_header`` of these belong to the header: a line end that is also the next separator's.
    """
    row = {field: "" for field in FIELD_KEYS.values()}
    metadata: dict[str, str] = {}
    for line in lines:
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        key = key.strip()
        if key in FIELD_KEYS and colon:
            row[FIELD_KEYS[key]] = value.strip()
        elif key not in KNOWN_KEYS:
            metadata[key] = value.strip()
    return row | {
        "metadata": list(metadata.items()),
        "content": content,
        "content_length": len(content),
        "missing": missing,
        "n_bytes": of_header,
    }


def _cut(data: bytes) -> Iterator[bytes]:
    """``data`` cut at the separator, which is lost."""
    at = 0
    while (found := data.find(b"\n" + MARK, at)) >= 0:
        yield data[at:found]
        at = found + 1 + len(MARK)
    yield data[at:]


def split_records(pieces: Iterable[bytes]) -> Iterator[dict]:
    """Records of one file part, from its pieces in order.

    Bytes between a payload and the next mark are skipped. A record the bytes do not
    suffice for comes last, with the number of bytes it lacks in ``missing``.
    """
    parts: list[bytes] = []  # of the open record
    have = wanted = 0
    header = None
    for piece in pieces:
        if parts:
            parts.append(b"\n" + MARK + piece)
        else:
            parts = [piece if piece.startswith(MARK) else MARK + piece]
            have, wanted, header = 0, 0, None
        have += len(parts[-1])
        while parts and have >= wanted:
            data = b"".join(parts)
            parts = [data]
            header = header or _read_header(data)
            if header is None:
                break
            lines, length, at = header
            wanted = at + length
            if have < wanted:
                break
            yield _as_row(lines, data[at:wanted])
            # another mark may follow the payload at once or on a later line
            start = wanted if data.startswith(MARK, wanted) else data.find(b"\n" + MARK, wanted) + 1
            parts = [data[start:]] if start else []
            have, wanted, header = len(data) - start, 0, None
    if parts:
        data = b"".join(parts)
        header = header or _read_header(data) or _read_header(data + b"\n")
        lines, length, at = header or ([], 0, len(data))
        yield _as_row(lines, data[at:], at + length - len(data) if header else -1, max(0, at - len(data)))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one by one; pieces may be large, so no batch becomes Python values at once."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _cut_chunks(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Like :func:`_cut`, of data that comes in chunks; only the piece that has not ended is held."""
    mark = b"\n" + MARK
    held: list[bytes] = []
    end = b""  # of what is held, where a separator may begin
    for chunk in chunks:
        if mark in end + chunk:
            *whole, rest = b"".join([*held, chunk]).split(mark)
            yield from whole
            held, chunk = [], rest
            end = b""
        held.append(chunk)
        end = (end + chunk)[1 - len(mark) :]
    yield b"".join(held)


def _without_tail(pieces: Iterable[bytes], claimed: int, tail: list[bytes]) -> Iterator[bytes]:
    """The pieces of a split after its first ``claimed`` bytes, which belong to an earlier split's record and go to ``tail``.

    Pieces have lost the separator in front of them, which counts.
    """
    for piece in pieces:
        if not claimed:
            yield piece
            continue
        data = b"\n" + MARK + piece
        tail.append(data[:claimed])
        rest, claimed = data[claimed:], max(0, claimed - len(data))
        if rest.startswith(MARK):  # the record ends right before a mark
            yield rest


RECORD, TAIL, END = "record", "tail", "end"
PARSED = f"{schemas.WARC}, block BIGINT, kind STRING, missing BIGINT, claimed BIGINT, n_bytes BIGINT, ends_file BOOLEAN"
_ARROW = pa.schema(
    [
        ("record_type", pa.string()),
        ("warc_date", pa.string()),
        ("record_id", pa.string()),
        ("content_type", pa.string()),
        ("content_length", pa.int32()),
        ("metadata", pa.map_(pa.string(), pa.string())),
        ("content", pa.binary()),
        ("file_path", pa.string()),
        ("record_number", pa.int64()),
        ("block", pa.int64()),
        ("kind", pa.string()),
        ("missing", pa.int64()),
        ("claimed", pa.int64()),
        ("n_bytes", pa.int64()),
        ("ends_file", pa.bool_()),
    ]
)


def _records_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of pieces, in file order, to batches of rows of three kinds.

    A ``record`` is numbered inside its split and may miss bytes if it is the last one. ``tail`` holds the
    first ``claimed`` bytes of a split. ``end`` says how many records (``record_number``) and bytes a split has.
    """
    upcoming = _rows(batches)
    row = next(upcoming, None)
    ready: list[dict] = []
    size = 0
    while row is not None:
        part, claimed = (row["source"], row["block"]), row["claimed"]
        n_bytes = 0

        def pieces() -> Iterator[bytes]:
            nonlocal row, n_bytes
            opens_file = row["block"] == 0
            while row is not None and (row["source"], row["block"]) == part:
                piece = row["piece"]
                row = next(upcoming, None)
                for part_of_piece in _cut(piece):
                    n_bytes += len(part_of_piece) + 1 + len(MARK)
                    # before the first mark of a file nothing counts
                    if not opens_file or part_of_piece.startswith(MARK):
                        yield part_of_piece
                    opens_file = False

        tail: list[bytes] = []
        place = {"file_path": part[0], "block": part[1], "claimed": claimed, "ends_file": row["ends_file"]}
        number = -1
        for number, record in enumerate(split_records(_without_tail(pieces(), claimed, tail))):
            ready.append(record | place | {"kind": RECORD, "record_number": number})
            size += record["content_length"] + 512
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(ready, schema=_ARROW)
                ready, size = [], 0
        if tail:
            ready.append(place | {"kind": TAIL, "content": b"".join(tail)})
        ready.append(place | {"kind": END, "record_number": number + 1, "n_bytes": n_bytes})
        # a task may read many small splits
        size += sum(map(len, tail)) + 512
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(ready, schema=_ARROW)
            ready, size = [], 0
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=_ARROW)


def _inflated(pieces: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """The content of each gzip member in chunks, from the file part cut where members seem to begin.

    The mark of a member may turn up by chance inside another one, which then goes on with the next piece. A member is to be
    used up before the next one is asked for. Raises ``zlib.error`` if the pieces are not whole members.
    """

    def chunks(piece: bytes | None) -> Iterator[bytes]:
        member = zlib.decompressobj(wbits=31)
        while piece is not None:
            for packed in chain([MEMBER], (piece[k : k + PACKED] for k in range(0, len(piece), PACKED))):
                if member.eof:
                    raise zlib.error("followed by other bytes")
                more = True
                while more and not member.eof:
                    data = member.decompress(packed, CHUNK)
                    packed = member.unconsumed_tail
                    if data:
                        yield data
                    # a full chunk may leave output inside the member
                    more = bool(packed) or len(data) == CHUNK
                if member.unused_data:
                    raise zlib.error("followed by other bytes")
            piece = None if member.eof else next(pieces, None)
        if not member.eof:
            raise zlib.error("not whole")

    for piece in pieces:
        yield chunks(piece)


def _records_of_member(chunks: Iterator[bytes]) -> Iterator[dict]:
    """The records of a member, as it is inflated; raises ``zlib.error`` where it turns out not to hold whole records."""
    first = last = b""

    def looked_at() -> Iterator[bytes]:
        nonlocal first, last
        for chunk in chunks:
            if len(first) < len(MARK):
                first += chunk[: len(MARK) - len(first)]
                if not MARK.startswith(first):
                    raise zlib.error("not of whole records")
            last = chunk[-1:]
            yield chunk

    for record in split_records(_cut_chunks(looked_at())):
        if record["missing"] is not None:
            # nothing in the member at all is no record either
            if first:
                raise zlib.error("not of whole records")
            continue
        yield record
    if first and (first != MARK or last != b"\n"):
        raise zlib.error("not of whole records")


def _records_of_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of pieces cut at ``MEMBER``, in file order, to batches of ``record`` and ``end`` rows.

    An ``end`` row has ``missing`` set if the split is not made of members that hold whole records; its records then do not count.
    """
    upcoming = _rows(batches)
    row = next(upcoming, None)
    ready: list[dict] = []
    size = 0
    while row is not None:
        part = (row["source"], row["block"])
        # a file begins with the mark, in front of which there is nothing
        opened = bool(row["block"]) or not row["piece"]
        if not row["block"]:
            row = next(upcoming, None)

        def pieces() -> Iterator[bytes]:
            nonlocal row
            while row is not None and (row["source"], row["block"]) == part:
                piece = row["piece"]
                row = next(upcoming, None)
                yield piece

        place = {"file_path": part[0], "block": part[1], "claimed": 0, "ends_file": False}
        number, whole = 0, opened
        of_split = pieces()
        try:
            for chunks in _inflated(of_split) if opened else ():
                for record in _records_of_member(chunks):
                    ready.append(record | place | {"kind": RECORD, "record_number": number})
                    number += 1
                    size += record["content_length"] + 512
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(ready, schema=_ARROW)
                        ready, size = [], 0
        except zlib.error:
            whole = False
            for _ in of_split:
                pass
        ready.append(place | {"kind": END, "record_number": number, "missing": None if whole else 1})
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=_ARROW)


def _members(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """The numbered records of ``.gz`` files made of members with whole records, and the files that are not."""
    pieces = spark.read.options(**UNPACKED).text(paths, lineSep=MEMBER.decode("latin-1")).select(
        F.col("value").cast("binary").alias("piece"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    parsed = _written(pieces.mapInArrow(_records_of_members, PARSED)).withColumn("file_key", F.xxhash64("file_path"))
    broken = parsed.filter("kind = 'end' AND missing IS NOT NULL").select("file_path", "file_key").distinct()
    others = {row.file_path: row.file_key for row in broken.collect()}  # no more than the listed files
    if others:
        keys = spark.createDataFrame([(key,) for key in others.values()], "file_key BIGINT")
        parsed = parsed.join(F.broadcast(keys), "file_key", "left_anti")
    there = {_local(path): path for path in paths}
    return _ending(_numbered(parsed)), [there[_local(path)] for path in others]


def _local(path: str) -> str:
    """One spelling for the ways in which paths are listed."""
    return re.sub("^([a-z0-9+.-]+):/+", r"\1:/", unquote(path))


def _pieces(spark: SparkSession, path: Paths) -> DataFrame:
    return read_pieces(spark, path, SEPARATOR).select(
        F.col("piece").cast("binary").alias("piece"),
        "source",
        "block",
        F.lit(0).cast("bigint").alias("claimed"),
        (F.col("block_end") >= F.col("source_size")).alias("ends_file"),
    )


def _whole_files(spark: SparkSession, path: Paths) -> DataFrame:
    """Plain files as one piece each, as far as a binary value goes (2 GB)."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("content").alias("piece"),
        F.col("path").alias("source"),
        F.lit(0).cast("bigint").alias("block"),
        F.lit(0).cast("bigint").alias("claimed"),
        F.lit(True).alias("ends_file"),
    )


def _parsed(pieces: DataFrame) -> DataFrame:
    return pieces.mapInArrow(_records_of_partition, PARSED)


@contextmanager
def _splits_of(spark: SparkSession, split_bytes: str | None) -> Iterator[None]:
    """Scans that are planned inside are split at ``split_bytes``."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split_bytes or before)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_warc(
    spark: SparkSession,
    path: Paths,
    splittable: bool = True,
    numbered: bool = True,
    with_truncated: bool = False,
    large_gzip: int = LARGE_GZIP,
    split_bytes: str | None = None,
) -> DataFrame:
    """One row per record; ``record_number`` counts from 0 in each file.

    A plain file is read by as many tasks as it has splits, and so is a ``.gz`` file of more than ``large_gzip`` bytes if its
    members hold whole records; other packed files are read by one. Plain files and large ``.gz`` files are
    parsed once, into a table in the shared folder that the result reads; numbers and records that
    reach over the end of a split are settled from it. ``numbered=False`` writes nothing and parses as the result is
    read: numbers then count inside a split, and a record that reaches into another split fails the query.
    ``splittable=False`` reads plain files whole, without a table either.

    ``split_bytes`` sets the size of the splits of plain files that are numbered, by default the session's. Smaller splits do
    not make more tasks or files: a task reads several, as much together as the session's size asks for.

    The cut-off last record of a damaged file is dropped, or kept and marked by
    ``with_truncated``, which adds a ``truncated`` column.
    """
    # listed names are encoded as URIs; paths are not
    names = [unquote(name) for name in spark.read.text(path).inputFiles()]
    plain = [name for name in names if not name.endswith((".gz", ".bz2", ".zst"))]
    packed = [name for name in names if name.endswith((".gz", ".bz2", ".zst"))]
    found = []
    if plain and splittable and numbered:
        found.append(_settled(spark, plain if packed else path, split_bytes))
    elif plain and splittable:
        problem = F.concat(F.lit("a record of "), "file_path", F.lit(" does not end in its split; read the file with numbers or with splittable=False"))
        inner = F.col("missing").isNotNull() & ~F.col("ends_file")
        lacks = F.when(inner, F.raise_error(problem).cast("boolean")).otherwise(F.col("missing").isNotNull())
        found.append(_ending(_parsed(_pieces(spark, plain if packed else path)).filter(F.col("kind") == RECORD), lacks))
    elif plain:
        found.append(_ending(_parsed(_whole_files(spark, plain)).filter(F.col("kind") == RECORD)))
    large = _large(spark, packed, large_gzip) if splittable and numbered else []
    if large:
        of_members, others = _members(spark, large)
        found.append(of_members)
        packed = sorted(set(packed) - set(large) | set(others))
    if packed or not names:
        found.append(_ending(_parsed(_pieces(spark, packed if plain or large else path)).filter(F.col("kind") == RECORD)))
    records = reduce(DataFrame.unionByName, found)
    return records if with_truncated else records.filter(~F.col("truncated")).drop("truncated")


def _large(spark: SparkSession, packed: list[str], least: int) -> list[str]:
    """The ``.gz`` files of more than ``least`` bytes, by their listing; those whose name ends in ``!.gz`` do not split."""
    names = {_local(name): name for name in packed if name.endswith(".gz") and not name.endswith("!.gz")}
    if not names:
        return []
    listed = spark.read.format("binaryFile").load(list(names.values())).where(F.col("length") > least).select("path")
    return sorted(names[_local(row.path)] for row in listed.collect())


RECORD_COLUMNS = [field.strip().split(" ")[0] for field in re.sub("<.*?>", "", schemas.WARC).split(",")]


def _ending(records: DataFrame, missing: Column | None = None) -> DataFrame:
    lacks = F.col("missing").isNotNull() if missing is None else missing
    return records.select(*RECORD_COLUMNS, lacks.alias("truncated"))


def _written(parsed: DataFrame) -> DataFrame:
    path = fresh_dir(parsed.sparkSession, "warc-parsed")
    parsed.write.parquet(path)
    return parsed.sparkSession.read.schema(parsed.schema).parquet(path)


def _numbered(parsed: DataFrame) -> DataFrame:
    """The records of parsed splits, numbered in their files, by the number of records that every split ends with."""
    earlier = W.partitionBy("file_key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = parsed.filter("kind = 'end'")
    offsets = ends.select("file_key", "block", F.coalesce(F.sum("record_number").over(earlier), F.lit(0)).alias("offset"))
    records = parsed.filter("kind = 'record'").join(small_per_split(offsets), ["file_key", "block"])
    return records.withColumn("record_number", F.col("record_number") + F.col("offset"))


CLAIMS = "file_key BIGINT, block BIGINT, claimed BIGINT, owner BIGINT"


def _claims(blocks: list[int], sizes: dict[int, int], missing: dict[tuple[int, int], int]) -> dict[int, tuple[int, int]]:
    """Per split of one file that an earlier record reaches into: how many bytes it claims, and the split of that record.

    ``missing`` tells what the last record of a split lacks if so many bytes are claimed. Where that is not
    known yet, it is taken to be what it is without a claim, as records fall into step again.
    """
    claims, lacks, owner = {}, 0, -1
    for block in blocks:
        claimed = min(lacks, sizes[block])
        if claimed:
            claims[block] = (claimed, owner)
        if lacks > sizes[block] or claimed == sizes[block]:
            lacks -= claimed
            continue
        lacks, owner = missing.get((block, claimed), missing[block, 0]), block
    return claims


def _settled(spark: SparkSession, path: Paths, split_bytes: str | None = None) -> DataFrame:
    """The records of split plain files, numbered, with those that reach over the end of a split put together.

    Only numbers reach the driver: of files in which a record lacks bytes, a row per split.
    """
    key = F.xxhash64("file_path").alias("file_key")
    n_tasks = max(1, _pieces(spark, path).rdd.getNumPartitions()) if split_bytes else None

    def written(pieces: DataFrame) -> DataFrame:
        with _splits_of(spark, split_bytes):
            return _written(_parsed(pieces.coalesce(n_tasks) if n_tasks else pieces))

    parsed = written(_pieces(spark, path))
    rows = parsed.filter("kind = 'record' AND missing IS NOT NULL").select(key, "block", "claimed", "missing").collect()
    sizes: dict[int, dict[int, int]] = {}
    if rows:
        files = spark.createDataFrame([(file,) for file in {row.file_key for row in rows}], "file_key BIGINT")
        for row in parsed.filter("kind = 'end'").select(key, "block", "n_bytes").join(F.broadcast(files), "file_key").collect():
            sizes.setdefault(row.file_key, {})[row.block] = row.n_bytes
    known: dict[int, dict[tuple[int, int], int]] = {file: {(block, 0): 0 for block in of_file} for file, of_file in sizes.items()}
    claims: dict[tuple[int, int], tuple[int, int]] = {}
    seen = set()
    while True:
        for row in rows:
            known[row.file_key][row.block, row.claimed] = row.missing
        claims = {
            (file, block): claim
            for file, of_file in sizes.items()
            for block, claim in _claims(sorted(of_file), of_file, {k: max(n, 0) for k, n in known[file].items()}).items()
        }
        fresh = [(file, block, claimed, owner) for (file, block), (claimed, owner) in claims.items() if (file, block, claimed) not in seen]
        if not fresh:
            break
        seen.update(row[:3] for row in fresh)
        wanted = spark.createDataFrame(fresh, CLAIMS).select(F.col("file_key").alias("k"), F.col("block").alias("b"), F.col("claimed").alias("c"))
        # the same splits as before, since the same files are listed
        again = _pieces(spark, path).join(F.broadcast(wanted), (F.xxhash64("source") == F.col("k")) & (F.col("block") == F.col("b")))
        latest = written(again.withColumn("claimed", F.col("c")).drop("k", "b", "c"))
        for file, block, claimed, _ in fresh:
            known[file][block, claimed] = 0
        rows = latest.filter("kind = 'record' AND missing IS NOT NULL").select(key, "block", "claimed", "missing").collect()
        parsed = parsed.unionByName(latest)
    for file, of_file in sizes.items():
        last = max(of_file)
        if any(known[file][block, claims.get((file, block), (0,))[0]] < 0 for block in of_file if block < last):
            raise ValueError("the header of a record does not end in its split; read the files with splittable=False")
    parsed = parsed.withColumn("file_key", key)
    if claims:
        settled = spark.createDataFrame([(*place, *claim) for place, claim in claims.items()], CLAIMS)
        settled = settled.select("file_key", "block", F.col("claimed").alias("settled"), "owner")
        parsed = parsed.join(F.broadcast(settled), ["file_key", "block"], "left").filter(F.col("claimed") == F.coalesce("settled", F.lit(0)))
    records = _numbered(parsed)
    if not claims:
        return _ending(records)
    in_order = F.sort_array(F.collect_list(F.struct("block", "content")))
    tails = parsed.filter("kind = 'tail'").groupBy("file_key", F.col("owner").alias("block")).agg(in_order.alias("parts"))
    rest = F.aggregate("parts", F.lit(b""), lambda joined, part: F.concat(joined, part["content"]))
    tails = tails.select("file_key", "block", rest.alias("rest"))
    crossing = F.col("missing").isNotNull()
    whole = records.filter(crossing).join(tails, ["file_key", "block"], "left")
    content = F.concat("content", F.substring("rest", F.col("n_bytes").cast("int") + 1, F.octet_length("rest")))
    whole = whole.withColumn("missing", F.col("missing") - F.coalesce(F.octet_length("rest"), F.lit(0)))
    whole = whole.withColumn("content", F.when(F.col("rest").isNull(), F.col("content")).otherwise(content)).withColumn("content_length", F.octet_length("content"))
    return _ending(records.filter(~crossing)).unionByName(_ending(whole, F.col("missing") != 0))


def header_text(line_end: str = "\n", version: str = VERSION_LINE) -> Column:
    """The header of a record as text: type and date first, id, content type, length last."""
    metadata = F.array_join(
        F.transform(
            F.map_entries("metadata"),
            lambda entry: F.concat(entry["key"], F.lit(": "), entry["value"], F.lit(line_end)),
        ),
        "",
    )

    def field(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), value, F.lit(line_end))

    return F.concat(
        F.lit(version + line_end),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Date", F.col("warc_date")),
        metadata,
        field("WARC-Record-ID", F.col("record_id")),
        field("Content-Type", F.col("content_type")),
        field(LENGTH_KEY, F.octet_length("content").cast("string")),
    )


def to_warc_text(line_end: str = "\n", version: str = VERSION_LINE) -> Column:
    """A whole record: header, blank line, payload. The payload bytes are kept as they are."""
    return F.concat(
        header_text(line_end, version), F.lit(line_end), F.col("content").cast("string")
    )


def write_warc(
    df: DataFrame,
    path: str,
    gzip: bool = False,
    line_end: str = "\r\n",
    version: str = VERSION_LINE,
    mode: str = "errorifexists",
) -> None:
    """Records to archive files, two line ends after each payload."""
    # the text writer adds the last line feed
    gap = F.lit(line_end * 2).substr(F.lit(1), F.lit(2 * len(line_end) - 1))
    write_lines(
        df.select(F.concat(to_warc_text(line_end, version), gap).alias("line")), path, gzip, mode
    )


def metadata_item(key: str) -> Column:
    """A header value by its key; the known keys are answered from their fields."""
    if key in FIELD_KEYS:
        return F.col(FIELD_KEYS[key])
    if key == LENGTH_KEY:
        return F.col("content_length").cast("string")
    return F.try_element_at(F.col("metadata"), F.lit(key))


def target_uri() -> Column:
    return metadata_item("WARC-Target-URI")


def trec_id() -> Column:
    return metadata_item("WARC-TREC-ID")


def put_metadata(key: Column, value: Column) -> Column:
    """The metadata with one entry set; known keys are refused."""
    others = F.map_filter("metadata", lambda name, _: name != key)
    return F.when(key.isin(*KNOWN_KEYS), F.col("metadata")).otherwise(
        F.map_concat(others, F.create_map(key, value))
    )


def clear_metadata() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def metadata_entries(df: DataFrame, *keep: str) -> DataFrame:
    """One row per metadata entry, as ``key`` and ``value``."""
    return df.select(*keep, F.explode("metadata"))


def total_record_length() -> Column:
    """Characters of the header text plus bytes of the payload."""
    return F.length(header_text()) + F.octet_length("content")


def content_text() -> Column:
    """The payload as UTF-8, with U+FFFD for what is not."""
    return F.make_valid_utf8(F.col("content").cast("string"))


def warc_responses(df: DataFrame) -> DataFrame:
    return df.filter(F.lower("record_type") == "response")
