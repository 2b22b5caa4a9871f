"""Moves and copies in tasks, journalled so that a run that died can go on.

A run's folder on shared storage holds ``intent``, the plan as a table that is
written before anything moves; ``log``, one file a task attempt with a line for
each place that was chosen and for each outcome; and ``lease``, by which one
driver at a time works on the run. ``resume`` does what no outcome is logged for
yet, as often as it is called.

Tasks may run twice or die anywhere, so every step can be repeated. A file is
linked to its place, which fails if something is there, and then unlinked; a
link and its source are one file, so whoever comes second sees what was done.
Where links do not work the file is copied beside its place under a name of its
own, checked, and put there under an empty file that was made exclusively; if
both are found later, with equal content, the source goes. The chosen place is
logged before it is used. Nothing is ever overwritten.

Defined results, beside those of ``actions.move``: an intent that is listed twice
is done once; a file that is at its logged or wanted place with the size of the
intent, and not at its old one, is ``moved``; an empty plan is a run without
outcomes.
"""

from __future__ import annotations

import errno
import hashlib
import json
import os
import shutil
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.actions import access
from shelfloom.runtime import ship

INTENT = "id string, kind string, original string, destination string, size long, survivor string, survivor_goes boolean"
LOG = "id string, chosen string, outcome string"
#: Of several outcomes of one intent the first of these counts.
BEST = ("moved", "restored", "already_there", "failed", "skipped_error", "skipped_readonly", "skipped_protected", "missing", "gone")
#: Seconds after which a lease that was not renewed may be taken.
LEASE = 60.0


class Held(RuntimeError):
    """Another driver works on the run."""


def _local(root: str) -> str:
    if root.startswith("file:"):
        return "/" + root[5:].lstrip("/")
    if "://" in root:
        raise ValueError(f"files are moved on mounted storage, and {root} is none")
    return root


def begin(plan: DataFrame, root: str, run: str, kind: str = "move") -> str:
    """Write the intents of a run and return its folder. ``plan`` has (original, destination), and may have size and survivor. A
    run that has its intents keeps them."""
    spark = plan.sparkSession
    place = Path(_local(root)) / run
    done = place / "intent"
    if done.exists():
        return str(place)
    for name, type_ in (("size", "long"), ("survivor", "string")):
        if name not in plan.columns:
            plan = plan.withColumn(name, F.lit(None).cast(type_))
    rows = plan.groupBy("original").agg(F.min(F.struct("destination", "size", "survivor")).alias("_p")).select("original", "_p.*")
    going = rows.select(F.col("original").alias("_going"))
    rows = rows.join(going, F.col("survivor") == F.col("_going"), "left")
    rows = rows.select(
        F.sha2("original", 256).alias("id"), F.lit(kind).alias("kind"), "original", "destination", F.col("size").cast("long").alias("size"), "survivor",
        F.col("_going").isNotNull().alias("survivor_goes"),
    )
    made = place / f"intent-{uuid.uuid4().hex}"
    rows.write.parquet(f"file://{made}")
    os.rename(made, done)  # all of them or none
    return str(place)


@contextmanager
def lease(place: str, seconds: float = LEASE):
    """Work on a run alone: ``Held`` if another's lease was renewed within ``seconds``."""
    path = Path(place) / "lease"
    me = uuid.uuid4().hex
    while True:
        try:
            with open(path, "x", encoding="utf-8") as f:
                f.write(me)
            break
        except FileExistsError:
            try:
                age = time.time() - path.stat().st_mtime
            except FileNotFoundError:
                continue
            if age < seconds:
                raise Held(f"{place}: its lease is {age:.0f} s old") from None
            old = path.with_name(f"lease-{uuid.uuid4().hex}")
            try:
                os.rename(path, old)  # one taker alone succeeds
            except FileNotFoundError:
                continue
    over = threading.Event()

    def renew():
        while not over.wait(seconds / 4):
            os.utime(path)

    thread = threading.Thread(target=renew, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        if path.exists() and path.read_text(encoding="utf-8") == me:
            path.unlink()


def intents(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema(INTENT).parquet(f"file://{place}/intent")


def _log(spark: SparkSession, place: str) -> DataFrame:
    if not any(Path(place, "log").glob("*.jsonl")):
        return spark.createDataFrame([], LOG)
    # a line that was cut off by a crash is none
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(f"file://{place}/log").filter("id is not null")


def outcomes(spark: SparkSession, place: str) -> DataFrame:
    """(id, original, destination, outcome, size, survivor) of every intent: the best outcome that is logged, null if there is
    none yet; destination is where the file lies now, null if it did not move."""
    rank = F.array_position(F.array(*map(F.lit, BEST)), F.col("outcome"))
    best = _log(spark, place).filter("outcome is not null").groupBy(F.col("id").alias("_id")).agg(F.min(F.struct(rank.alias("rank"), "outcome", "chosen")).alias("_o"))
    found = intents(spark, place).join(best, F.col("id") == F.col("_id"), "left")
    return found.select("id", "original", F.col("_o.chosen").alias("destination"), F.col("_o.outcome").alias("outcome"), "size", "survivor")


def _remaining(spark: SparkSession, place: str) -> DataFrame:
    log = _log(spark, place)
    done = log.filter("outcome is not null").select(F.col("id").alias("_id"))
    chosen = log.filter("outcome is null").groupBy(F.col("id").alias("_cid")).agg(F.collect_set("chosen").alias("tried"))
    todo = intents(spark, place).join(done, F.col("id") == F.col("_id"), "left_anti")
    return todo.join(chosen, F.col("id") == F.col("_cid"), "left").drop("_cid")


def resume(spark: SparkSession, place: str, *, force: bool = False, parts: int | None = None, seconds: float = LEASE, after: Callable[[str], None] | None = None) -> DataFrame:
    """Do what is left of a run and return ``outcomes``. ``after`` is called in the task with the id of everything done."""
    ship(spark)
    with lease(place, seconds):
        todo = _remaining(spark, place)
        dealt = todo.repartition(parts or spark.sparkContext.defaultParallelism, "id")

        def work(frames) -> Iterator:
            log = None
            try:
                for frame in frames:
                    for row in frame.to_dict("records"):
                        if log is None:
                            os.makedirs(f"{place}/log", exist_ok=True)
                            log = open(f"{place}/log/{uuid.uuid4().hex}.jsonl", "x", encoding="utf-8")  # noqa: SIM115
                        outcome, at = _done(row, lambda path, id_=row["id"]: _write(log, {"id": id_, "chosen": path}), force)
                        _write(log, {"id": row["id"], "chosen": at, "outcome": outcome})
                        if after is not None:
                            after(row["id"])
                    yield frame[["id"]]
            finally:
                if log is not None:
                    os.fsync(log.fileno())
                    log.close()

        # the ids come back only so that the tasks run
        dealt.mapInPandas(work, "id string").write.format("noop").mode("overwrite").save()
    return outcomes(spark, place)


def _done(row: dict, note: Callable[[str], None], force: bool) -> tuple[str, str | None]:
    """Do one intent: its outcome, and where the file lies now."""
    tried = [] if row["tried"] is None else list(row["tried"])
    if row["kind"] == "copy":
        return _restored(row["original"], row["destination"], tried, note)
    size = None if row["size"] is None or row["size"] != row["size"] else int(row["size"])
    return _moved(row["original"], row["destination"], size, row["survivor"], bool(row["survivor_goes"]), tried, note, force)


def _write(log, line: dict) -> None:
    log.write(json.dumps(line) + "\n")
    log.flush()


def _digest(path: str) -> bytes:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(1 << 20):
            h.update(data)
    return h.digest()


def _equal(a: str, b: str) -> bool:
    return os.path.samefile(a, b) or os.path.getsize(a) == os.path.getsize(b) and _digest(a) == _digest(b)


def _place(source: str, target: str, unlink: bool) -> bool:
    """Put the file there; False if something is there already."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if unlink:
        try:
            os.link(source, target)
        except FileExistsError:
            return False
        except OSError as e:
            if e.errno not in (errno.EXDEV, errno.EPERM, errno.ENOTSUP, errno.EMLINK):
                raise
        else:
            # another attempt of the same task may have seen this link and taken the source away; the link is never taken back
            Path(source).unlink(missing_ok=True)
            return True
    beside = f"{target}.part-{uuid.uuid4().hex}"
    try:
        shutil.copy2(source, beside)
        if os.path.getsize(beside) != os.path.getsize(source):
            raise OSError(errno.EIO, "copied in part", beside)
        try:
            os.close(os.open(target, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        os.replace(beside, target)
    finally:
        if os.path.exists(beside):
            os.unlink(beside)
    if unlink:
        Path(source).unlink(missing_ok=True)
    return True


def _numbered(target: str, mark: str) -> Iterator[str]:
    yield target
    body, end = os.path.splitext(target)
    k = 1
    while True:
        yield f"{body}{mark.format(k)}{end}"
        k += 1


def _moved(original: str, wanted: str, size: int | None, survivor: str | None, survivor_goes: bool, chosen: list[str], note: Callable, force: bool) -> tuple[str, str | None]:
    if not os.path.lexists(original):
        there = [p for p in [*chosen, wanted] if os.path.exists(p) and size is not None and os.path.getsize(p) == size]
        return ("moved", there[0]) if there else ("gone", None)
    for p in chosen:
        # an attempt before this one put it there and died before the source went
        if os.path.exists(p) and _equal(original, p):
            Path(original).unlink(missing_ok=True)
            return "moved", p
        if os.path.exists(p) and not os.path.getsize(p):
            os.unlink(p)  # the empty file that kept the place
    if survivor and (survivor_goes or not os.path.exists(survivor)):
        return "skipped_error", None
    state = access(original)
    if state == "protected" or state == "force_deletable" and not force:
        return ("skipped_readonly" if state == "force_deletable" else "skipped_protected"), None
    try:
        if state == "force_deletable":
            os.chmod(original, 0o600)
        for target in _numbered(wanted, "_{}"):
            if os.path.exists(target) and os.path.samefile(original, target):
                Path(original).unlink(missing_ok=True)  # an attempt beside this one has linked it
                return "moved", target
            if os.path.lexists(target):
                continue
            note(target)
            if _place(original, target, True):
                return "moved", target
    except FileNotFoundError:
        return "gone", None
    except OSError:
        return "failed", None
    raise AssertionError


def _restored(original: str, actual: str | None, chosen: list[str], note: Callable) -> tuple[str, str | None]:
    if actual is None or not os.path.exists(actual):
        return "missing", None
    for p in chosen:
        if os.path.exists(p) and _equal(actual, p):
            return "restored", p
        if os.path.exists(p) and not os.path.getsize(p):
            os.unlink(p)
    if os.path.exists(original) and os.path.getsize(original) == os.path.getsize(actual):
        return "already_there", original
    body, end = os.path.splitext(original)
    names = [original] if not os.path.lexists(original) else []
    try:
        for target in (*names, *(f"{body}_restored{end}" if k < 2 else f"{body}_restored_{k}{end}" for k in range(1, 1 << 20))):
            if os.path.lexists(target):
                continue
            note(target)
            if _place(actual, target, False):
                return "restored", target
    except OSError:
        pass
    return "failed", None
