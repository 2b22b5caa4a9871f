"""Text renderings of a ledger, and the parsers that read them back.

A report is read whole, in one task, and its lines are numbered where it is
read; what comes out are rows. Missing fields are null; reports without groups
or removals give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfloom.actions import Move, free_name
from shelfloom.catalog import REPORTS
from shelfloom.functions.dates import stored_date
from shelfloom.functions.names import after_colon, provenance
from shelfloom.operators.ranking import numbered
from shelfloom.runtime import materialise, ship

# The signs and labels of report lines, by which reports are read back.
GROUP, KEPT, GONE, REASON = "\U0001f9e9 Group #{}", "\U0001f7e2 Kept {}:", "\u274c Deleted {}:", "\U0001f4cc {}: {}"
NAME, PATH, MOVED = "\U0001f4c4 {}", "\U0001f4c1 Path: {}", "\U0001f4e5 Moved to: {}"
FIELDS = {
    "size_mb": "\U0001f4be Size: {} MB",
    "dimensions": "\U0001f4d0 Dimensions: {}",
    "extracted_date": "\U0001f4c5 Date Extracted: {}",
    "date_source": "\U0001f9ed Date Source:    {}",
    "filename_importance": "\U0001f522 Filename Importance: {}/9",
    "modified_time": "\U0001f552 Modified: {}",
}
PERCENT = "\U0001f3af Similarity: {} %"
TITLES = {
    "duplicates": ("Duplicate Images", "Image", "Images"), "similar": ("Visually Similar Images", "Image", "Images"), "corrupted": ("Corrupted Images", "Image", "Images"),
    "small_images": ("Small Images", "Image", "Images"), "duplicate_video": ("Exact Duplicate Videos", "File", "Files"), "duplicate_office": ("Duplicate Office Files", "File", "Files"),
    "duplicate_archives": ("Duplicate Archives", "File", "Files"), "duplicate_other": ("Duplicate Files", "File", "Files"),
}
TEXT = {
    "criterion_decided": "Decided by {}",
    "provenance_gate": "The name of the other file is that of a copy or a recovered file",
    "tie": "All criteria about equal; the first by name stays",
    "tie_alphabetical": "All criteria about equal; the other is first by name",
    "recovered_name": "The name is that of a recovered file",
    **{f"lower_{c}": f"Less {w}" for c, w in (("resolution", "resolution"), ("size", "size"), ("date", "favoured date"), ("filename", "important name"))},
}


def reason_text(code: str | None, criterion: str | None = None) -> str:
    return TEXT.get(code, code or "unknown").format(criterion)


def file_lines(path: str, info: Mapping | None, moved: str | None) -> list[str]:
    """Name, place and what is known of one file; ``info`` is a row of
    ``flows.file_info`` as a dict."""
    info = info or {}
    out = [NAME.format(Path(path).name), PATH.format(path), *([MOVED.format(moved)] if moved else [])]
    size = f"{info['width']}x{info['height']}" if info.get("width") and info.get("height") else None
    date = info.get("extracted_date")
    known = {**info, "dimensions": size, "extracted_date": f"{date} (day only)" if date and info.get("date_only") else date}
    out += [line.format(known[key]) for key, line in FIELDS.items() if known.get(key) is not None]
    return [f"  {line}" for line in out]


#: Groups in one report that tasks write.
GROUPS = 10_000


def rendered(ledger: DataFrame, kind: str) -> DataFrame:
    """(report, grp, at, line): the lines of duplicate and similar reports, ``GROUPS`` groups a report. ``ledger`` has a row a
    file: grp, path, is_kept, reason, criterion, and may have moved, percent and the columns of ``flows.file_info``. Groups are in
    the order of their names, the kept file first, the others by path; rows without a group are in no report."""
    one, many = TITLES[kind][1:]
    has = lambda c: F.col(c) if c in ledger.columns else F.lit(None).cast("string")
    rows = ledger.filter("grp is not null")
    order = numbered(rows.select("grp").distinct(), [], ["grp"], "_number").withColumnRenamed("grp", "_grp")
    gone = rows.filter("not is_kept").groupBy("grp").agg(F.min("path").alias("_first")).withColumnRenamed("grp", "_lost")
    rows = rows.join(materialise(order, "report-groups"), F.col("grp") == F.col("_grp")).join(materialise(gone, "report-losers"), F.col("grp") == F.col("_lost"), "left")

    def put(template: str, value: Column, indent: str = "  ") -> Column:
        before, after = template.split("{}", 1) if "{}" in template else (template, "")
        return F.concat(F.lit(indent + before), value.cast("string"), F.lit(after))  # null where the value is

    when = has("extracted_date")
    if "date_only" in ledger.columns:
        when = F.when(F.col("date_only"), F.concat(when, F.lit(" (day only)"))).otherwise(when)
    sized = F.when((has("width") > 0) & (has("height") > 0), F.concat_ws("x", has("width").cast("string"), has("height").cast("string")))
    known = {**{c: has(c) for c in FIELDS}, "dimensions": sized, "extracted_date": when}
    file = [put(NAME, F.substring_index("path", "/", -1)), put(PATH, F.col("path")), put(MOVED, has("moved")), *(put(line, known[c]) for c, line in FIELDS.items())]
    decided = F.create_map(*[F.lit(x) for code, text in TEXT.items() for x in (code, text.split("{}")[0])])
    reason = F.coalesce(F.try_element_at(decided, F.col("reason")), F.col("reason"), F.lit("unknown"))
    said = F.when(F.col("reason") == "criterion_decided", F.concat(reason, F.coalesce(has("criterion"), F.lit("None")))).otherwise(reason)
    name, text = REASON.split("{}", 1)[0], ": "
    kept = [put(GROUP, F.col("_number"), ""), F.lit(KEPT.format(one)), *file, F.concat(F.lit(f"{name}Selection Reason{text}"), said)]
    lost = [F.when(F.col("path") == F.col("_first"), F.lit(GONE.format(many))), *file, put(PERCENT, has("percent")), F.concat(F.lit(f"  {name}Deletion Reason{text}"), said)]
    lines = F.array_compact(F.when(F.col("is_kept"), F.array(*kept)).otherwise(F.array(*lost)))
    number = F.floor((F.col("_number") - 1) / GROUPS).alias("report")
    out = rows.select(number, "grp", F.col("_number"), "is_kept", "path", F.posexplode(lines).alias("_at", "line"))
    # a file's place in its report
    at = F.struct("_number", (~F.col("is_kept")).alias("_lost"), "path", "_at")
    return out.select("report", "grp", at.alias("at"), "line")


def write_rendered(lines: DataFrame, kind: str, folder: str, prefix: str, *, dry_run: bool, bin_path: str) -> DataFrame:
    """Write the lines of ``rendered`` into a folder that driver and tasks share, a file a report, and return (report, path). A
    file is written beside its place and renamed, so a task that runs again changes nothing."""
    ship(lines.sparkSession)
    head = "\n".join(_head(kind, [], dry_run, bin_path, {}))

    def run(frames):
        import os
        import uuid

        out = name = beside = None

        def closed():
            out.close()
            os.replace(beside, f"{folder}/{prefix}_{name:06d}.txt")
            return name, f"{folder}/{prefix}_{name:06d}.txt"

        done = []
        for frame in frames:
            for report, line in zip(frame["report"].tolist(), frame["line"].tolist(), strict=True):
                if report != name:
                    if out is not None:
                        done.append(closed())
                    name, beside = report, f"{folder}/.{uuid.uuid4().hex}"
                    out = open(beside, "w", encoding="utf-8")  # noqa: SIM115
                    out.write(head + "\n")
                out.write(line + "\n")
        if out is not None:
            done.append(closed())
        yield pd.DataFrame(done, columns=["report", "path"])

    import pandas as pd

    Path(folder).mkdir(parents=True, exist_ok=True)
    dealt = lines.repartition("report").sortWithinPartitions("report", "at").select("report", "line")
    return materialise(dealt.mapInPandas(run, "report long, path string"), "reports")


def _head(kind: str, moves: list[Move], dry_run: bool, bin_path: str, counts: dict[str, int]) -> list[str]:
    failed = sum(m.outcome == "failed" for m in moves)
    lines = [f"{TITLES[kind][0]}: Deletion Report", "=" * 60, f"Dry run: {'yes' if dry_run else 'no'}", f"Bin: {bin_path}", f"Failed: {failed}"]
    return [*lines, *(f"{name}: {n}" for name, n in counts.items()), "=" * 60, ""]


def render(kind: str, groups: Iterable[dict], moves: list[Move], infos: Mapping[str, Mapping] | None = None, *, dry_run: bool, bin_path: str) -> str:
    """Duplicate and similar reports. ``groups``: dicts of kept, reason,
    criterion, and losers: (path, reason) pairs, or (path, reason, percent) of
    similar ones; video groups may have ``why`` per loser and for the kept."""
    groups, infos = list(groups), infos or {}
    moved = {m.original: m.destination for m in moves if m.outcome == "moved"}
    one, many = TITLES[kind][1:]
    lines = _head(kind, moves, dry_run, bin_path, {"Total Groups": len(groups), "Total Files Deleted": sum(len(g["losers"]) for g in groups)})
    for k, g in enumerate(groups, 1):
        lines += [GROUP.format(k), KEPT.format(one), *file_lines(g["kept"], infos.get(g["kept"]), None)]
        lines += [REASON.format("Selection Reason", reason_text(g["reason"], g.get("criterion"))), GONE.format(many)]
        for path, reason, *percent in g["losers"]:
            lines += file_lines(path, infos.get(path), moved.get(path))
            lines += [f"  {PERCENT.format(p)}" for p in percent if p is not None]
            lines += ["  " + REASON.format("Deletion Reason", reason_text(reason))]
        lines.append("")
    return "\n".join(lines)


def render_files(kind: str, files: Iterable[tuple[str, str]], moves: list[Move], infos: Mapping[str, Mapping] | None = None, *, dry_run: bool, bin_path: str) -> str:
    """A report of single files, corrupt or small: (path, why it goes)."""
    files, infos = list(files), infos or {}
    moved = {m.original: m.destination for m in moves if m.outcome == "moved"}
    why = Counter(reason for _, reason in files)
    lines = _head(kind, moves, dry_run, bin_path, {"Files": len(files), **{f"  {k}": n for k, n in sorted(why.items())}})
    lines += [GONE.format(TITLES[kind][2])] if files else ["No files"]
    for path, reason in files:
        lines += [*file_lines(path, infos.get(path), moved.get(path)), "  " + REASON.format("Reason", reason)]
    return "\n".join([*lines, ""])


def render_restore(outcomes: Iterable[tuple[str, str]], ambiguous: int = 0) -> str:
    """A report of (original, outcome) pairs with the count of each outcome."""
    outcomes = list(outcomes)
    counts = Counter(o for _, o in outcomes)
    lines = ["Restore", *(f"  {k}: {n}" for k, n in sorted(counts.items())), f"  ambiguous: {ambiguous}", ""]
    return "\n".join([*lines, *(f"{outcome}: {original}" for original, outcome in outcomes), ""])


def operation_of(name: str, section: str) -> str | None:
    """The operation of a section whose report has this file name, by the
    longest prefix that fits; None for other sections' reports."""
    return max((p for p in REPORTS[section] if name.startswith(p + "_")), key=len, default=None)


def write(folder: str, prefix: str, stamp: str, text: str) -> str:
    target = free_name(Path(folder) / f"{prefix}_{stamp}.txt")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")
    return str(target)


def find_reports(folder: str, section: str) -> dict[str, list[str]]:
    """operation -> reports of one section, newest first."""
    found: dict[str, list[str]] = {op: [] for op in REPORTS[section]}
    for path in sorted(Path(folder).glob("*.txt"), key=lambda p: p.name, reverse=True):
        operation = operation_of(path.name, section)
        if operation:
            found[operation].append(str(path))
    return found


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(report, at, line) of every line, trimmed, in file order."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("report"), "value")
    lines = whole.select("report", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    return lines.select("report", "at", F.trim(F.regexp_replace("line", "^[\\s\ufeff]+", "")).alias("line")).filter("line <> ''")


def _marked(sign: str) -> Column:
    return F.col("line").contains(sign)


def parse(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(report, original, reported) of every removal: a moved line belongs to
    the last path line before it that no moved line has used."""
    lines = _lines(spark, paths).filter(_marked(PATH[0]) | _marked(MOVED[0]))
    w = Window.partitionBy("report").orderBy("at")
    lines = lines.withColumn("_value", after_colon(F.col("line"))).filter(_marked(MOVED[0]) | F.col("_value").isNotNull())
    before = F.lag(F.when(_marked(PATH[0]), F.col("_value"))).over(w)
    pairs = lines.withColumn("original", before).filter(_marked(MOVED[0]) & F.col("original").isNotNull() & F.col("_value").isNotNull())
    return pairs.select("report", "original", F.col("_value").alias("reported"))


def parse_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(report, grp, is_kept, reason, path, name, extracted_date, date_source,
    filename_importance, width, height, size_mb, modified_time) of every file of
    every group of duplicate and similar reports."""
    line = F.col("line")
    w = Window.partitionBy("report").orderBy("at")
    sign = lambda text: text.split("{")[0].strip()
    role = F.when(line.startswith(sign(KEPT)), True).when(line.startswith(sign(GONE)), False)
    lines = _lines(spark, paths).withColumn("_group", F.sum(line.startswith(sign(GROUP)).cast("int")).over(w)).filter("_group > 0")
    lines = lines.withColumn("_file", F.sum(line.startswith(sign(NAME)).cast("int")).over(w)).withColumn("is_kept", F.last(role, ignorenulls=True).over(w))
    chosen = F.regexp_extract("line", "^" + sign(REASON) + " Selection Reason:\\s*(.*)$", 1)
    field = lambda text, tail="(.*)": F.nullif(F.trim(F.max(F.regexp_extract("line", "^" + sign(text) + "\\s*" + tail, 1))), F.lit(""))
    number = "([0-9.]+)"
    files = lines.filter("_file > 0 and is_kept is not null").groupBy("report", "_group", "_file", "is_kept").agg(
        field(NAME).alias("name"),
        field(PATH).alias("path"),
        field(FIELDS["extracted_date"]).alias("extracted_date"),
        field(FIELDS["date_source"]).alias("date_source"),
        field(FIELDS["filename_importance"], number).try_cast("int").alias("filename_importance"),
        field(FIELDS["dimensions"], "([0-9]+)x").try_cast("long").alias("width"),
        field(FIELDS["dimensions"], "[0-9]+x([0-9]+)").try_cast("long").alias("height"),
        field(FIELDS["size_mb"], number).try_cast("double").alias("size_mb"),
        field(FIELDS["modified_time"]).alias("modified_time"),
    )
    reasons = lines.groupBy("report", "_group").agg(F.nullif(F.max(chosen), F.lit("")).alias("reason"))
    named = files.filter("path is not null").join(reasons, ["report", "_group"])
    grp = F.concat_ws("#", "report", F.col("_group").cast("string")).alias("grp")
    return named.select("report", grp, "is_kept", "reason", "path", "name", "extracted_date", "date_source", "filename_importance", "width", "height", "size_mb", "modified_time")


def replayable(groups: DataFrame) -> DataFrame:
    """Rows of ``parse_groups`` as ``selection.replay_causes`` takes them: what
    the report recorded, with the dates of that run as they were compared."""
    ts = stored_date(F.col("extracted_date"))
    return groups.select(
        "grp",
        "path",
        "name",
        (F.col("width") * F.col("height")).alias("pixels"),
        (F.col("size_mb") * 1048576).cast("long").alias("size"),
        F.col("filename_importance").alias("importance"),
        provenance(F.col("name")).alias("provenance"),
        ts.alias("ts"),
        F.when(ts.isNotNull(), F.coalesce("date_source", F.lit("none"))).otherwise("none").alias("ts_source"),
        F.col("is_kept").alias("was_kept"),
        ts.alias("old_ts"),
        F.lit("none").alias("old_source"),
    )
