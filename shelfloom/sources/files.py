"""Sources: a folder walker in tasks, content and digests by path, and
adapters from tables.

Spark's own ``binaryFile`` silently leaves out names that start with a dot or
an underscore, which the filters have to see and count.

Defined results: a missing or unreadable folder has no files; a file that goes
away or cannot be read has null content and digests; no files give no rows.
"""

from __future__ import annotations

import os
import stat
import zlib
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "path string, name string, ext string, size long, mtime timestamp_ntz, ctime timestamp_ntz, device long, "
    "unreadable boolean, not_regular boolean, hidden boolean, system boolean"
)


#: The same for Arrow.
ARROW = pa.schema([
    ("path", pa.string()), ("name", pa.string()), ("ext", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us")), ("ctime", pa.timestamp("us")),
    ("device", pa.int64()), ("unreadable", pa.bool_()), ("not_regular", pa.bool_()), ("hidden", pa.bool_()), ("system", pa.bool_()),
])


def extension(name: str) -> str:
    return os.path.splitext(name)[1].lower()


def entry_row(path: str, hidden: bool) -> tuple:
    """What the file system says of one entry, in the order of ``SCHEMA``."""
    name = os.path.basename(path)
    try:
        s = os.stat(path)
    except OSError:
        return path, name, extension(name), None, None, None, None, True, False, hidden, False
    mtime, ctime = (datetime.fromtimestamp(t, timezone.utc).replace(tzinfo=None) for t in (s.st_mtime, s.st_ctime))
    regular = stat.S_ISREG(s.st_mode)
    return path, name, extension(name), s.st_size, mtime, ctime, s.st_dev, False, not regular, hidden, False


#: A task of ``files`` hands folders on once it has seen so many entries, and a
#: folder that has more is dealt out by name.
SHARE = 20_000
#: Files above this size have no ``content``; ``streamed_hashes`` reads any.
BIG = 1 << 30


def _entries(folder: str, hidden: bool, wanted: set[str] | None, share: int, shares: int):
    """(row or None, folder or None, hidden) of everything in one folder whose
    name falls to the share."""
    try:
        entries = os.scandir(folder)
    except OSError:
        return
    for e in entries:
        if shares > 1 and zlib.crc32(os.fsencode(e.name)) % shares != share:
            continue
        inner = hidden or e.name.startswith(".")
        fits = wanted is None or extension(e.name) in wanted
        if e.is_dir(follow_symlinks=False):
            yield None, e.path, inner
            # a folder that is named like a file is seen and counted
            if wanted is None or not fits:
                continue
        if fits:
            yield entry_row(e.path, inner), None, inner


def _count(folder: str) -> int:
    try:
        return sum(1 for _ in os.scandir(folder))
    except OSError:
        return 0


def files(spark: SparkSession, folders: list[str], extensions: list[str] | None = None) -> DataFrame:
    """Files of several folders; a path below two of them comes once, hidden only
    if it is so for both. An empty list of extensions wants nothing, a missing
    folder has nothing. Tasks walk the folders; one that has seen ``SHARE``
    entries hands its open folders on, to be dealt out again, and a folder with
    more entries than that is handed on in shares by checksum of the name."""
    import pandas as pd

    from shelfloom.runtime import materialise, ship

    if not folders or extensions == []:
        return spark.createDataFrame([], SCHEMA)
    ship(spark)
    wanted = None if extensions is None else set(extensions)
    fields = [f.split()[0] for f in SCHEMA.split(", ")]

    def walk(frames):
        for frame in frames:
            stack = list(zip(frame["folder"], frame["hidden"], frame["share"], frame["shares"]))
            rows, seen, handed = [], 0, []
            while stack and seen < SHARE:
                folder, hidden, share, shares = stack.pop()
                if not shares:  # not counted yet
                    n = _count(folder)
                    shares = max(1, -(-n // SHARE))
                    if shares > 1:
                        handed += [(folder, hidden, k, shares) for k in range(shares)]
                        seen += n
                        continue
                for row, below, inner in _entries(folder, hidden, wanted, share, shares):
                    seen += 1
                    if below is not None:
                        stack.append((below, inner, 0, 0))
                    else:
                        rows.append((*row, None, None, None, None))
            rows += [(*[None] * len(fields), folder, bool(hidden), k, n) for folder, hidden, k, n in stack + handed]
            out = pd.DataFrame(rows, columns=[*fields, "_folder", "_hidden", "_share", "_shares"])
            kinds = {"Int64": ("size", "device", "_share", "_shares"), "boolean": ("unreadable", "not_regular", "hidden", "system", "_hidden")}
            yield out.astype({c: kind for kind, columns in kinds.items() for c in columns})

    roots = list(dict.fromkeys(os.path.abspath(f) for f in folders))
    nested = any(a != b and a.startswith(b.rstrip("/") + "/") for a in roots for b in roots)
    todo = spark.createDataFrame([(f, False, 0, 0) for f in roots], "folder string, hidden boolean, share int, shares int")
    parts = []
    while True:
        dealt = todo.repartition("folder", "share")
        found = materialise(dealt.mapInPandas(walk, f"{SCHEMA}, _folder string, _hidden boolean, _share int, _shares int"), "walk")
        inner = ["_folder", "_hidden", "_share", "_shares"]
        parts.append(found.filter("_folder is null").drop(*inner))
        todo = found.filter("_folder is not null").select(*[F.col(c).alias(c[1:]) for c in inner])
        if todo.isEmpty():
            break
    out = reduce(DataFrame.unionByName, parts)
    if not nested:
        return out
    # only roots inside each other give a path twice
    whole = F.struct(*[F.col(c) for c in out.columns])
    return out.groupBy("path").agg(F.min_by(whole, "hidden").alias("_one")).select("_one.*")


def with_content(found: DataFrame) -> DataFrame:
    """``content`` of every file, read by its path on shared storage, one file
    at a time; null if it cannot be read or is over ``BIG`` bytes, which a row
    can hardly hold (``streamed_hashes`` reads those)."""
    from shelfloom.runtime import ship

    ship(found.sparkSession)

    def run(frames):
        for frame in frames:
            for k in range(len(frame)):
                one = frame.iloc[[k]].copy()
                one["content"] = [_read(one["path"].iloc[0])]
                yield one

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInPandas(run, f"{fields}, content binary")


def _read(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read() if os.fstat(f.fileno()).st_size <= BIG else None
    except OSError:
        return None


def head(path: str, size: int = 1 << 20) -> bytes | None:
    """The first bytes of a file, null if it cannot be read."""
    try:
        with open(path, "rb") as f:
            return f.read(size)
    except OSError:
        return None


def streamed_hashes(found: DataFrame, sample: int | None = None, block: int = 1 << 20) -> DataFrame:
    """(path, sha256) read block by block, for files of any size; with
    ``sample`` the digest of size, head and tail, whose ranges alone are read.
    Null if unreadable. With a ``size``, every task gets about the same bytes to
    read (``balance``)."""
    import hashlib

    import pandas as pd

    from shelfloom.runtime import ship
    from shelfloom.sources.balance import balanced

    ship(found.sparkSession)

    def digest(path: str) -> str | None:
        try:
            with open(path, "rb") as f:
                if sample is None:
                    h = hashlib.sha256()
                    while data := f.read(block):
                        h.update(data)
                    return h.hexdigest()
                size = os.fstat(f.fileno()).st_size
                h = hashlib.sha256(size.to_bytes(8, "big") + f.read(sample))
                if size > 2 * sample:
                    f.seek(-sample, os.SEEK_END)
                    h.update(f.read(sample))
                return h.hexdigest()
        except OSError:
            return None

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "sha256": [digest(p) for p in frame["path"]]})

    dealt = balanced(found.select("path", "size"), read_bytes(F.col("size"), sample), "path") if "size" in found.columns else found
    return dealt.select("path").mapInPandas(run, "path string, sha256 string")


def read_bytes(size: F.Column, sample: int | None = None) -> F.Column:
    """What is read of a file: all of it, or its head and tail."""
    return size if sample is None else F.least(size, F.lit(2 * sample))


def from_table(rows: DataFrame, *, path: F.Column, content: F.Column, mtime: F.Column | None = None) -> DataFrame:
    """Rows of a table as files: the content is any text or binary column."""
    from shelfloom.functions.names import base_name, suffix

    data = F.coalesce(content.cast("binary"), F.lit(b""))
    return rows.select(
        path.alias("path"),
        base_name(path).alias("name"),
        F.lower(suffix(base_name(path))).alias("ext"),
        F.octet_length(data).cast("long").alias("size"),
        (mtime if mtime is not None else F.lit(None)).cast("timestamp_ntz").alias("mtime"),
        data.alias("content"),
    )
