"""WARC: write records, normalise monolithic gzip archives, read them back.

A *monolithic* archive is one gzip stream around the whole file, which no
reader can seek in. The normaliser inflates such a stream once, front to back,
rewrites every record as a gzip member of its own and writes a sidecar index
of (offset, length) per record. Archives that already hold one member per
record, or mix both forms, pass through the same code.

Archives travel as rows (archive, content): what ``binaryFile`` reads. In
memory a task holds one Arrow batch of archives (64 MiB as Spark sets it, or
one larger archive) and one record.

Defined results: a null payload is an empty one; payloads under
``MIN_REVISIT`` bytes are always responses; rows that repeat a page (same id,
same payload) are all responses if their id is the smallest; a null id never
is the smallest unless all ids of the payload are null; payloads of any length
are written and read whole; an empty table gives no archive; a truncated archive raises ``ValueError`` with the archive's name.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.llm.common import key_maps, looked_up, materialise, renamed, ship

MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
READ_BYTES = 1 << 16
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One uncompressed record; line ends in header values become blanks."""
    lines = [VERSION]
    for name, value in {**headers, "Content-Length": str(len(block))}.items():
        lines.append(f"{name}: {re.sub(r'[\r\n]+', ' ', value)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, piecewise."""
    engine, fresh = zlib.decompressobj(31), True
    for chunk in chunks:
        while chunk:
            fresh = False
            plain = engine.decompress(chunk, 1 << 20)
            if plain:
                yield plain
            if engine.eof:
                chunk, engine, fresh = engine.unused_data, zlib.decompressobj(31), True
            else:
                chunk = engine.unconsumed_tail
    if not fresh:
        raise ValueError("truncated gzip stream")


def records(plain: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a plain WARC stream."""
    source, buffer = iter(plain), bytearray()

    def fill(size: int) -> bool:
        while len(buffer) < size:
            more = next(source, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        while fill(1) and buffer[0] in b"\r\n":
            del buffer[0]
        if not buffer:
            return
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                raise ValueError("truncated record header")
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["Content-Length"])
        if not fill(end + 4 + size):
            raise ValueError("truncated record block")
        block = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]
        yield headers, block


def normalise(chunks: Iterable[bytes]) -> Iterator[tuple[int, bytes, dict[str, str]]]:
    """(offset, member, headers) of every record, in file order."""
    offset = 0
    for headers, block in records(inflate(chunks)):
        plain = record_bytes({k: v for k, v in headers.items() if k != "Content-Length"}, block)
        member = gzip.compress(plain, 6, mtime=0)
        yield offset, member, headers
        offset += len(member)


def _slices(data: bytes) -> Iterator[bytes]:
    view = memoryview(data)
    for i in range(0, len(view), READ_BYTES):
        yield bytes(view[i : i + READ_BYTES])


def normalise_file(source: str | Path, target: str | Path) -> int:
    """Rewrite one file and its sidecar index ``<target>.idx`` (one line a
    record: offset, length, record id, type); returns the number of records."""
    n = 0
    with open(source, "rb") as f, open(target, "wb") as out, open(f"{target}.idx", "w") as index:
        for offset, member, headers in normalise(iter(lambda: f.read(READ_BYTES), b"")):
            out.write(member)
            index.write(f"{offset}\t{len(member)}\t{headers.get('WARC-Record-ID', '')}\t{headers.get('WARC-Type', '')}\n")
            n += 1
    return n


def read_at(path: str | Path, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of a normalised file, without reading the rest."""
    with open(path, "rb") as f:
        f.seek(offset)
        return next(records(inflate([f.read(length)])))


def with_roles(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(_id, _url, _html, _digest, _bytes, _first): the payload's digest, size
    and, where other pages share it, the smallest page id. A page that only
    revisits another has no ``_html``, as no record will hold it."""
    html = F.coalesce(F.col("_html"), F.lit(""))
    rows = renamed(pages, _id=id_col, _url=url_col, _html=payload_col).select(
        "_id",
        "_url",
        html.alias("_html"),
        F.sha2(html, 256).alias("_digest"),
        F.octet_length(html).cast("long").alias("_bytes"),
    )
    shared = (
        rows.filter(F.col("_bytes") >= MIN_REVISIT)
        .groupBy(F.col("_digest").alias("_d"))
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select("_d", "_first")
    )
    shared = materialise(shared, "warc-shared")
    # Pages stay where they are read. A map of the shared digests tells which pages may share theirs, and a map of the first
    # pages which of those may be first; only the others' ids and digests, and the first pages, meet the table.
    digest, page = F.xxhash64("_digest"), F.xxhash64("_digest", "_id")
    maps = key_maps(shared.select(F.xxhash64("_d").alias("_hash")), shared.select(F.xxhash64("_d", "_first").alias("_hash")))
    told = looked_up(rows, maps, {"_shares": (digest, 0), "_leads": (page, 1)})
    alone = told.filter("not _shares").select(*rows.columns, F.lit(None).cast(shared.schema["_first"].dataType).alias("_first"))
    some = told.filter("_shares").withColumn("_html", F.when(F.col("_leads"), F.col("_html")))
    met = some.join(shared, F.col("_digest") == F.col("_d"), "left")
    # the map is wrong of a few pages that share nothing: these have lost their payload and are taken as they were
    known = met.filter("_first is not null or _leads").select(*rows.columns, "_first")
    wrong = met.filter("_first is null and not _leads").select("_id", "_digest")
    wrong = materialise(wrong.distinct(), "warc-wrong")
    if wrong.isEmpty():
        return alone.union(known)
    back = rows.join(wrong.hint("merge"), rows["_id"].eqNullSafe(wrong["_id"]) & (rows["_digest"] == wrong["_digest"]), "left_semi")
    return alone.union(known).union(back.select(*rows.columns, F.lit(None).cast(shared.schema["_first"].dataType).alias("_first")))


def write_archives(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """(archive, content): monolithic gzip archives of about ``archive_bytes``
    of payload, one after another in every task."""
    ship(pages.sparkSession)
    rows = with_roles(pages, id_col=id_col, url_col=url_col, payload_col=payload_col)

    def run(batches):
        task = TaskContext.get().partitionId()
        engine, parts, held, seq = None, [], 0, 0

        def closed():
            nonlocal engine, parts, held, seq
            parts.append(engine.flush())
            out = pa.RecordBatch.from_pydict(
                {"archive": [f"pages-{task:06d}-{seq:06d}.warc.gz"], "content": [b"".join(parts)]},
                schema=pa.schema([("archive", pa.string()), ("content", pa.binary())]),
            )
            engine, parts, held, seq = None, [], 0, seq + 1
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                payload = (row["_html"] or "").encode("utf-8", "surrogatepass")
                revisit = row["_first"] is not None and row["_first"] != row["_id"]
                headers = {
                    "WARC-Type": "revisit" if revisit else "response",
                    "WARC-Record-ID": f"<urn:page:{'' if row['_id'] is None else row['_id']}>",
                    "WARC-Target-URI": row["_url"] or "",
                    "WARC-Date": "1970-01-01T00:00:00Z",
                    "WARC-Payload-Digest": f"sha256:{row['_digest']}",
                    "Content-Type": "text/html; charset=utf-8",
                }
                if revisit:
                    headers |= {
                        "WARC-Refers-To": f"<urn:page:{row['_first']}>",
                        "WARC-Profile": REVISIT_PROFILE,
                        "X-Payload-Length": str(row["_bytes"]),
                    }
                engine = engine or zlib.compressobj(6, zlib.DEFLATED, 31)
                parts.append(engine.compress(record_bytes(headers, b"" if revisit else payload)))
                held += len(payload)
                if held >= archive_bytes:
                    yield closed()
        if engine is not None:
            yield closed()

    return rows.mapInArrow(run, "archive string, content binary")


def normalised(archives: DataFrame, *, name_col: str = "archive", content_col: str = "content") -> DataFrame:
    """(archive, seq, offset, length, record_id, record_type, member): the
    members of every normalised file in order, with their index entries.
    The file is the members by ``seq``; the sidecar is the other columns."""

    ship(archives.sparkSession)
    schema = "archive string, seq long, offset long, length long, record_id string, record_type string, member binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                archive, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                held: list[tuple] = []
                size = 0
                try:
                    for seq, (offset, member, h) in enumerate(normalise(_slices(content or b""))):
                        held.append((archive, seq, offset, len(member), h.get("WARC-Record-ID"), h.get("WARC-Type"), member))
                        size += len(member)
                        if size > 4 << 20:
                            yield _batch(names, held)
                            held, size = [], 0
                except (ValueError, zlib.error, KeyError) as e:
                    raise ValueError(f"{archive}: {e}") from e
                if held:
                    yield _batch(names, held)

    return archives.select(name_col, content_col).mapInArrow(run, schema)


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"seq": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "member": pa.binary()}
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=names
    )


def export_files(members: DataFrame, folder: str) -> None:
    """Write normalised files and their sidecars into a folder that driver and
    executors share. Each file is written under a temporary name and renamed,
    so a repeated task leaves one whole file."""

    def run(frames):
        import os
        import uuid

        out, name, tmp = None, None, None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.archive != name:
                    if out:
                        finish(out, tmp, name)
                    name, tmp = row.archive, f"{folder}/.{uuid.uuid4().hex}"
                    out = (open(tmp, "wb"), open(tmp + ".idx", "w"))
                out[0].write(row.member)
                out[1].write(f"{row.offset}\t{row.length}\t{row.record_id}\t{row.record_type}\n")
        if out:
            finish(out, tmp, name)
        yield from ()

    def finish(files, tmp, name):
        import os

        for f in files:
            f.close()
        os.replace(tmp, f"{folder}/{name}")
        os.replace(tmp + ".idx", f"{folder}/{name}.idx")

    Path(folder).mkdir(parents=True, exist_ok=True)
    members.repartition("archive").sortWithinPartitions("archive", "seq").mapInPandas(run, "done long").count()


def read_members(members: DataFrame) -> DataFrame:
    """Every record as its member says: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A response's size and digest are
    taken from its payload and must agree with its header."""

    ship(members.sparkSession)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long"
    kinds = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64())]
    )

    def number(text: str) -> int | None:
        found = text.removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found else None

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                h, block = next(records(inflate([batch.column(2)[i].as_py()])))
                told = h["WARC-Payload-Digest"].removeprefix("sha256:")
                if h["WARC-Type"] == "revisit":
                    size, refers = int(h["X-Payload-Length"]), number(h["WARC-Refers-To"])
                else:
                    size, refers = len(block), None
                    if hashlib.sha256(block).hexdigest() != told:
                        raise ValueError(f"{batch.column(0)[i].as_py()}: a payload differs from its digest")
                rows.append((number(h["WARC-Record-ID"]), size, told, h["WARC-Type"], refers, batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return members.select("archive", "offset", "member").mapInArrow(run, schema)


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    archives = materialise(write_archives(pages), "warc-monolithic")
    members = materialise(normalised(archives), "warc-members")
    return read_members(members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
