"""Actions on a decision ledger: plan, move, restore. Moves and copies run on
the driver, as tasks may run twice; everything before them is a plan.

Defined results: rows that repeat a path are planned as files of their own;
null names and folders form a group; an empty table plans nothing; a removed
file that is listed twice is located twice.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.config import Safety
from shelfloom.functions.names import stem, strip_collision, suffix
from shelfloom.operators.ranking import numbered, running
from shelfloom.runtime import materialise, ship

RESERVE = 512 << 20
SKIPPED = ("dry_run", "skipped_readonly", "skipped_protected", "skipped_error")


def cleaned_folder(path: str, home: str | None = None) -> str:
    """The part of a source folder that is worth keeping in the recycle bin."""
    folder = Path(path).resolve().parent
    bases = [Path(home or Path.home()), Path(home or Path.home()).parent, Path("/")]
    base = next((b for b in bases if folder.is_relative_to(b)), Path("/"))
    parts, out, skip = list(folder.relative_to(base).parts), [], False
    for p in parts:
        low = p.lower()
        if skip:
            skip = False
        elif low in ("users", "user", "home"):
            skip = True
        elif low not in ("appdata", "temp", "tmp") and not low.startswith("tmp"):
            out.append(p)
    return "/".join(out) or folder.name or "misc"


def destinations(losers: DataFrame, bin_root: str, sub: str, taken: DataFrame | None = None) -> DataFrame:
    """``losers`` (path, name, folder) with ``destination``. The first file of
    a name in a folder, by path, keeps it unless it is ``taken`` (folder, name:
    what lies in the bin). Each other gets the next ``_1``, ``_2`` ... that no
    file of the folder bears, in the bin or on its way there."""
    keys = ["folder", "name"]
    names = losers.select(*[F.col(c).alias(f"_l{k}") for k, c in enumerate(losers.columns)], "folder", "name", F.col("path").alias("_path"), F.lit(1).alias("_own"))
    nothing = [F.lit(None).cast(f.dataType).alias(f"_l{k}") for k, f in enumerate(losers.schema.fields)]
    old = None if taken is None else materialise(taken.select(*keys).distinct(), "bin-names")
    rows = names
    if old is not None:  # what lies in the bin comes first of its name
        rows = names.unionByName(old.select(*nothing, *keys, F.lit(None).cast("string").alias("_path"), F.lit(0).alias("_own")))
    order = numbered(rows, keys, ["_own", "_path"], "_k").filter("_own = 1").withColumn("_k", F.col("_k") - 1)
    # numbers that files of the folder bear already, by the name they are a number of
    body, ending = stem(F.col("name")), suffix(F.col("name"))
    bare = r"(?s)^(.+)_([1-9][0-9]{0,17})$"
    there = names.select(*keys) if old is None else names.select(*keys).unionByName(old)
    used = there.select("folder", F.regexp_extract(body, bare, 1).alias("_stem"), ending.alias("_end"), F.regexp_extract(body, bare, 2).alias("_used")).filter("_used <> ''")
    used = used.select("folder", F.concat("_stem", "_end").alias("name"), F.col("_used").cast("long").alias("_used")).distinct()
    used = numbered(used, keys, ["_used"], "_j")
    # the k-th free number is k and one more for every used one below it: used j is below if used - j < k
    columns = [f"_l{k}" for k in range(len(losers.columns))]
    marks = used.select(*nothing, *keys, F.expr("2 * (_used - _j) + 1").alias("_at"), F.lit(1).cast("long").alias("_one"), F.lit(None).cast("long").alias("_k"))
    asks = order.filter("_k > 0").select(*columns, *keys, F.expr("2 * _k").alias("_at"), F.lit(0).cast("long").alias("_one"), "_k")
    placed = running(marks.unionByName(asks), keys, ["_at"], "_one", "_skip").filter("_k is not null")
    numbers = placed.select(*columns, *keys, (F.col("_k") + F.col("_skip")).alias("_k"))
    out = numbers.unionByName(order.filter("_k = 0").select(*columns, *keys, "_k"))
    renamed = F.when(F.col("_k") > 0, F.concat(body, F.lit("_"), F.col("_k").cast("string"), ending)).otherwise(F.col("name"))
    place = F.concat_ws("/", F.lit(bin_root), F.lit(sub), "folder", renamed)
    return out.select(*[F.col(f"_l{k}").alias(c) for k, c in enumerate(losers.columns)], place.alias("destination"))


def session_folders(folders: list[str], existing: set[str]) -> dict[str, str]:
    """The bin folder that each source folder uses in one run: itself, or where
    an earlier run has left it, the first free of ``name (2)``, ``name (3)``
    ..."""
    out = {}
    for folder in dict.fromkeys(folders):
        name, k = folder, 2
        while name in existing:
            name, k = f"{folder} ({k})", k + 1
        out[folder] = name
    return out


def capacity(losers: DataFrame, bin_device: int, free: int) -> DataFrame:
    """(needed, fits): bytes that cross volumes, with a reserve."""
    needed = F.coalesce(F.sum(F.when(F.col("device") != bin_device, F.col("size"))), F.lit(0))
    out = losers.agg(needed.cast("long").alias("needed"))
    return out.withColumn("fits", (F.col("needed") == 0) | (F.col("needed") + RESERVE <= free))


def access(path: str) -> str:
    """available, protected or force_deletable."""
    if os.access(path, os.W_OK) and os.access(os.path.dirname(path), os.W_OK):
        return "available"
    return "force_deletable" if os.access(os.path.dirname(path), os.W_OK) else "protected"


def with_access(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with ``access``, asked by the tasks on storage that
    they share; ``protected`` where the path is gone."""
    ship(files.sparkSession)

    def run(frames):
        for frame in frames:
            yield frame.assign(access=[access(p) if p is not None and os.path.exists(p) else "protected" for p in frame["path"]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "access")
    return files.drop("access").mapInPandas(run, f"{fields}, access string")


def refusal(count: int, safety: Safety, *, large_confirmed: bool = False, confirmed: bool = False) -> str | None:
    """Why an operation on ``count`` files may not start: too_many or
    unconfirmed; None if it may. ``count`` is ``deletable`` of
    ``dedup.totals``."""
    if 0 < safety.max_files < count and not large_confirmed:
        return "too_many"
    return "unconfirmed" if safety.confirm and not confirmed else None


@dataclass
class Move:
    original: str
    destination: str | None
    outcome: str  # moved, failed, gone, or one of SKIPPED


def free_name(path: Path, mark: str = "_{}") -> Path:
    """The path, or its next numbered form that does not exist."""
    out, k = path, 1
    while out.exists():
        out = path.with_name(f"{path.stem}{mark.format(k)}{path.suffix}")
        k += 1
    return out


def move(plan: Iterable[tuple[str, str]], *, survivors: Mapping[str, str] | None = None, dry_run: bool = True, force: bool = False) -> list[Move]:
    """Move (original, destination) pairs. ``survivors`` names the file that
    stays for each original: if that one is missing or is itself planned to go,
    the original may be the only copy left and stays. Originals without a
    survivor (corrupt or small files) are not copies and go. Repeating a
    finished plan changes nothing."""
    plan = list(plan)
    going = {os.path.realpath(original) for original, _ in plan}
    out = []
    for original, wanted in plan:
        source, target = Path(original), Path(wanted)
        if not source.exists():
            out.append(Move(original, None, "gone"))
        elif dry_run:
            out.append(Move(original, wanted, "dry_run"))
        elif (keeper := (survivors or {}).get(original)) and (not Path(keeper).exists() or os.path.realpath(keeper) in going):
            out.append(Move(original, None, "skipped_error"))
        elif (state := access(original)) == "protected" or state == "force_deletable" and not force:
            out.append(Move(original, None, "skipped_readonly" if state == "force_deletable" else "skipped_protected"))
        else:
            if state == "force_deletable":
                source.chmod(0o600)
            target.parent.mkdir(parents=True, exist_ok=True)
            target, size = free_name(target), source.stat().st_size
            shutil.move(original, target)
            ok = target.exists() and target.stat().st_size == size
            out.append(Move(original, str(target), "moved" if ok else "failed"))
    return out


def write_ledger(moves: list[Move], path: str, *, section: str = "", dry_run: bool = True, bin_path: str = "") -> str:
    """One JSON line per move with the run it belongs to, never over an
    existing file: dry run or not, the bin, and how many moves failed."""
    target = free_name(Path(path))
    target.parent.mkdir(parents=True, exist_ok=True)
    run = {"section": section, "dry_run": dry_run, "bin": bin_path, "failed": sum(m.outcome == "failed" for m in moves)}
    target.write_text("".join(json.dumps(asdict(m) | run) + "\n" for m in moves))
    return str(target)


def located(removed: DataFrame, in_bin: DataFrame) -> DataFrame:
    """``removed`` (original, reported, size) with ``actual``, its place in the
    bin (path, name, size), and ``status``: at its reported path, else by the
    reported name, else by the original name, where a name in the bin also
    counts without its collision number. Several are told apart by size, then
    the first by path is taken as ``ambiguous``; else found or missing. The bin
    is counted by name first, so every removed file meets one row a key.
    ``bin_index`` does the same on an index that is kept."""
    keys = bin_keys(in_bin.select("path", "name", "size"))
    one = materialise(_by_key(keys), "bin-keys")
    same = materialise(_by_size(keys), "bin-sizes")
    return _located(removed, one, same, in_bin.select(F.col("path").alias("_there")).distinct(), [F.col("reported") == F.col("_there")])


def bin_keys(in_bin: DataFrame) -> DataFrame:
    """(_key, _path, _name, _size, ...): every file of the bin (path, name, size, ...) under its name and under that without its
    collision number."""
    kept = in_bin.withColumnsRenamed({c: f"_{c}" for c in in_bin.columns})
    return kept.withColumn("_key", F.explode(F.array_distinct(F.array("_name", strip_collision(F.col("_name"))))))


def _by_key(keys: DataFrame) -> DataFrame:
    return keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_path").alias("_first"))


def _by_size(keys: DataFrame) -> DataFrame:
    return keys.groupBy("_key", "_size").agg(F.count(F.lit(1)).alias("_n"), F.min("_path").alias("_first"))


def _located(removed: DataFrame, one: DataFrame, same: DataFrame, there: DataFrame, at: list[F.Column]) -> DataFrame:
    tail = lambda c: F.substring_index(c, "/", -1)

    def met(rows: DataFrame, key: F.Column, tag: str) -> DataFrame:
        by_name = one.select(F.col("_key").alias(f"_k{tag}"), F.col("_n").alias(f"n{tag}"), F.col("_first").alias(f"f{tag}"))
        by_size = same.select(F.col("_key").alias(f"_l{tag}"), F.col("_size").alias(f"_s{tag}"), F.col("_n").alias(f"m{tag}"), F.col("_first").alias(f"g{tag}"))
        rows = rows.join(by_name, key == F.col(f"_k{tag}"), "left")
        return rows.join(by_size, (key == F.col(f"_l{tag}")) & (F.col("_size_of") == F.col(f"_s{tag}")), "left")

    items = removed.withColumn("_size_of", F.col("size"))
    items = items.join(there, at, "left")
    items = met(met(items, tail("reported"), "1"), tail("original"), "2")
    use = F.when(F.col("n1").isNotNull(), F.struct(F.col("n1").alias("n"), F.col("f1").alias("f"), F.col("m1").alias("m"), F.col("g1").alias("g"))).when(
        F.col("n2").isNotNull(), F.struct(F.col("n2").alias("n"), F.col("f2").alias("f"), F.col("m2").alias("m"), F.col("g2").alias("g"))
    )
    items = items.withColumn("_u", use)
    actual = F.coalesce("_there", "_u.g", "_u.f")
    single = F.col("_there").isNotNull() | (F.col("_u.n") == 1) | (F.col("_u.m") == 1)
    status = F.when(actual.isNull(), "missing").when(F.coalesce(single, F.lit(False)), "found").otherwise("ambiguous")
    return items.select(*removed.columns, actual.alias("actual"), status.alias("status"))


def restore(items: Iterable[tuple[str, str, str]], dry_run: bool = True) -> list[tuple[str, str]]:
    """Copy (original, actual, status) back; (original, outcome). Outcomes:
    missing, already_there, would_restore, restored, error. Nothing is ever
    overwritten: a different file in place gets a ``_restored`` neighbour."""
    out = []
    for original, actual, status in items:
        if status == "missing" or actual is None or not Path(actual).exists():
            out.append((original, "missing"))
            continue
        source, target = Path(actual), Path(original)
        size = source.stat().st_size
        if target.exists() and target.stat().st_size == size:
            out.append((original, "already_there"))
        elif dry_run:
            out.append((original, "would_restore"))
        else:
            if target.exists():
                target = target.with_name(f"{target.stem}_restored{target.suffix}")
                k = 2
                while target.exists():
                    target = Path(original).with_name(f"{Path(original).stem}_restored_{k}{target.suffix}")
                    k += 1
            target.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(source, target)
            ok = target.stat().st_size == size
            if not ok:
                target.unlink()
            out.append((original, "restored" if ok else "error"))
    return out
