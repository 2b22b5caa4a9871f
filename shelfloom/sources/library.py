"""Folders of files as a Spark data source, with filters pushed into the walk.

    register(spark)
    spark.read.format("file_library").load("/photos").filter("ext = '.jpg' and not hidden")

Tests on path, name, ext, hidden and system are decided on the name, before a
file is asked for its size; a test that no hidden file passes, or a prefix of the
path, closes whole folders. Tests on size and flags are decided before a row is
made. Spark keeps what is not decided here.

``partitions`` opens folders from the roots on until there are enough for
``numPartitions`` tasks (default 64) or it has seen ``PLANNED`` entries. A folder
with more than ``WIDE`` entries is shared by several tasks: each lists it, and asks
and returns only the names whose checksum falls to it. Folders that are still
closed are walked whole, each by ``k`` tasks that share every folder in it in
this way where there are fewer folders than tasks.

Defined results: as in ``files``: a missing or unreadable folder has no files; a
broken link is ``unreadable``, a folder named like a file ``not_regular``;
links to folders are not followed; several roots may overlap, and then a path
comes once for each root.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from shelfloom.sources.files import ARROW, SCHEMA, entry_row, extension

NAME = "file_library"
#: A folder with more entries is shared by several tasks.
WIDE = 20_000
#: Entries that the planning of tasks looks at, at most a folder more.
PLANNED = 200_000
ROWS = 8192
_FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
#: What is known before a file is asked, and what after.
EARLY = ("path", "name", "ext", "hidden", "system")
LATE = ("size", "device", "unreadable", "not_regular")


def decided(f: D.Filter, value) -> bool | None:
    """What a pushed filter says of its column's value, null for null."""
    match f:
        case D.IsNull():
            return value is None
        case D.IsNotNull():
            return value is not None
        case D.Not():
            inner = decided(f.child, value)
            return None if inner is None else not inner
        case D.EqualNullSafe():
            return value == f.value
    if value is None:
        return None
    match f:
        case D.EqualTo():
            return value == f.value
        case D.In():
            return value in f.value
        case D.GreaterThan():
            return value > f.value
        case D.GreaterThanOrEqual():
            return value >= f.value
        case D.LessThan():
            return value < f.value
        case D.LessThanOrEqual():
            return value <= f.value
        case D.StringStartsWith():
            return value.startswith(f.value)
        case D.StringEndsWith():
            return value.endswith(f.value)
        case D.StringContains():
            return f.value in value
    raise ValueError(f"not a filter of this source: {f}")


def _column(f: D.Filter) -> str | None:
    while isinstance(f, D.Not):
        f = f.child
    found = getattr(f, "attribute", ())
    return found[0] if len(found) == 1 else None


def _known(f: D.Filter) -> bool:
    try:
        decided(f, None)
        while isinstance(f, D.Not):
            f = f.child
        decided(f, f.value[0] if isinstance(f, D.In) else f.value if hasattr(f, "value") else "")
        return True
    except (ValueError, TypeError, IndexError):
        return False


@dataclass
class Part:
    """Entries of one folder, or of a whole tree, whose name's checksum leaves ``share`` when divided by ``shares``."""

    folder: str
    hidden: bool
    share: int = 0
    shares: int = 1
    deep: bool = False


class Task(D.InputPartition):
    def __init__(self, parts: list[Part]):
        super().__init__(None)
        self.parts = parts


class Walk(D.DataSourceReader):
    def __init__(self, folders: list[str], tasks: int, wide: int):
        self.folders, self.tasks, self.wide = folders, tasks, wide
        self.tests: list[tuple[str, D.Filter]] = []

    def pushFilters(self, filters):
        for f in filters:
            if _column(f) in EARLY + LATE and _known(f):
                self.tests.append((_column(f), f))
            else:
                yield f

    def _of(self, columns) -> list[tuple[str, D.Filter]]:
        return [(c, f) for c, f in self.tests if c in columns]

    def _open(self, folder: str, hidden: bool) -> bool:
        """Whether any file below the folder may pass."""
        if hidden and any(decided(f, True) is not True for c, f in self.tests if c == "hidden"):
            return False
        for c, f in self.tests:
            if c == "path" and isinstance(f, (D.StringStartsWith, D.EqualTo)):
                inside = folder.rstrip("/") + "/"
                if not (inside.startswith(f.value) or f.value.startswith(inside)):
                    return False
        return True

    def partitions(self):
        todo = deque((f, False) for f in self.folders if os.path.isdir(f))
        flat: list[tuple[int, Part]] = []  # folders whose own entries are dealt, with how many there are
        seen = 0
        while todo and seen < PLANNED and len(todo) + len(flat) < 4 * self.tasks:
            folder, hidden = todo.popleft()
            if not self._open(folder, hidden):
                continue
            n = 0
            try:
                for e in os.scandir(folder):
                    n += 1
                    if e.is_dir(follow_symlinks=False):
                        todo.append((e.path, hidden or e.name.startswith(".")))
            except OSError:
                continue
            seen += n
            shares = max(1, -(-n // self.wide))
            flat += [(-(-n // shares), Part(folder, hidden, k, shares)) for k in range(shares) if n]
        shares = max(1, self.tasks // len(todo)) if todo else 1
        deep = [Part(folder, hidden, k, shares, True) for folder, hidden in todo for k in range(shares)]
        # the fewest entries first: each task takes folders until it has its share of what was seen
        out: list[list[Part]] = []
        share, held, load = max(1, sum(n for n, _ in flat) // self.tasks), [], 0
        for n, part in sorted(flat, key=lambda x: x[0]):
            held.append(part)
            load += n
            if load >= share:
                out.append(held)
                held, load = [], 0
        if held:
            out.append(held)
        step = max(1, len(deep) // (4 * self.tasks))
        out += [deep[k::-(-len(deep) // step)] for k in range(-(-len(deep) // step))] if deep else []
        return [Task(parts) for parts in out] or [Task([])]

    def read(self, partition):
        early, late = self._of(EARLY), self._of(LATE)
        passes = lambda tests, values: all(decided(f, values[c]) is True for c, f in tests)
        rows: list[tuple] = []
        for part in partition.parts:
            for path, name, hidden in self._named(part):
                if early and not passes(early, {"path": path, "name": name, "ext": extension(name), "hidden": hidden, "system": False}):
                    continue
                row = entry_row(path, hidden)
                if late and not passes(late, dict(zip(_FIELDS, row, strict=True))):
                    continue
                rows.append(row)
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def _named(self, part: Part) -> Iterator[tuple[str, str, bool]]:
        """(path, name, hidden) of every entry that falls to the part: files, and folders named like files."""
        stack = [(part.folder, part.hidden)]
        while stack:
            folder, hidden = stack.pop()
            if not self._open(folder, hidden):
                continue
            try:
                entries = os.scandir(folder)
            except OSError:
                continue
            for e in entries:
                inner = hidden or e.name.startswith(".")
                folder_like = e.is_dir(follow_symlinks=False)
                if folder_like and part.deep:
                    stack.append((e.path, inner))
                # a folder counts only if it is named like a file
                if folder_like and not extension(e.name):
                    continue
                if part.shares == 1 or zlib.crc32(os.fsencode(e.name)) % part.shares == part.share:
                    yield e.path, e.name, inner


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class Library(D.DataSource):
    """Options: ``path`` (one root) or ``roots`` (a JSON list), ``numPartitions``, ``wide``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Walk:
        roots = json.loads(self.options.get("roots") or "null") or [self.options["path"]]
        roots = [os.path.abspath(r.removeprefix("file://") if r.startswith("file:///") else r) for r in roots]
        return Walk(roots, int(self.options.get("numPartitions", 64)), int(self.options.get("wide", WIDE)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark push filters into it."""
    from shelfloom.runtime import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Library)


def read(spark: SparkSession, folders: list[str], **options) -> DataFrame:
    """Files of several folders, which should not overlap."""
    register(spark)
    reader: Callable = spark.read.format(NAME).option("roots", json.dumps(list(dict.fromkeys(folders)))).options(**options).load
    return reader()
