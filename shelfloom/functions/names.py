"""File-name evidence as column expressions; no Python runs per row.

``importance`` grades a whole name from 1 to 9, ``provenance`` puts its stem
into a class from 0 (recovered) to 4 (original), ``video_provenance`` is the
variant for video names. ``evidence`` adds them to a table step by step, so that
what they share is made once and the generated code stays small. Nulls give
null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.functions import matching

RECOVERED, COPY, WEAK, NEUTRAL, ORIGINAL = range(5)

# Weights of name patterns. Patterns of Latin letters match whole
# words, others match anywhere; the longest that matches decides, the first
# listed among equals.
IMPORTANCE = {
    "recovered": 1,
    "copy": 2,
    "duplicate": 2,
    "نسخة": 2,
    "نسخه": 2,
    "backup": 3,
    "temp": 3,
    "tmp": 3,
    "cache": 3,
    "thumbnail": 4,
    "thumb": 4,
    "preview": 4,
    "img": 7,
    "image": 7,
    "photo": 7,
    "pic": 7,
    "picture": 7,
    "dsc": 8,
    "vid": 8,
    "video": 8,
    "screenshot": 6,
    "snapchat": 6,
    "whatsapp": 6,
    "camera": 8,
    "original": 8,
    **{f" ({n})": 2 for n in range(1, 10)},
    " - copy": 2,
    "_copy": 2,
    "new ": 3,
    "edited": 4,
    "modified": 4,
}
COPY_WORDS = ("_copy", "- copy", "duplicate", "نسخة", "نسخه")
# Words that tell where a file comes from.
RECOVERY_MARKERS = (
    "recovered recovery recover restored restore undeleted undelete salvaged salvage "
    "مستردة مسترد مستعادة مستعاد استرداد استعادة"
).split()
COPY_MARKERS = "copy clone duplicate نسخة نسخ مكررة مكرر تكرار".split()
WEAK_MARKERS = (
    "backup bak temp tmp edited modified new converted convert exported export احتياطية احتياطي مؤقت معدّل معدل"
).split()
VIDEO_ORIGINAL_MARKERS = "original orig camera video vid img image dsc dcim photo pic clip rec".split()
ORIGINAL_MARKERS = [*VIDEO_ORIGINAL_MARKERS, "screenshot", "snapchat", "whatsapp"]
VIDEO_IMPORTANCE = {4: 9, 3: 5, 2: 3, 1: 2, 0: 1}

# The shapes of copy counters and carved files. Blanks and digits of every script count, as in the
# rules; the classes are written out because they mean ASCII alone in Java and in SQL.
BLANK = "[\\s\\p{Z}]*"
NUMBERED = f"\\({BLANK}\\p{{Nd}}+{BLANK}\\)"
NUMBERED_END = f"\\({BLANK}\\p{{Nd}}+{BLANK}\\){BLANK}$"
YEAR_END = f"\\({BLANK}(19|20)\\p{{Nd}}\\p{{Nd}}{BLANK}\\){BLANK}$"
ARABIC_NUMBERED = f"نسخ[هة]{BLANK}\\p{{Nd}}+"
CARVED = "^[a-z]+_[0-9]+x[0-9]+x[0-9]+_[0-9]+$"
DATE_ONLY = r"^[0-9\-_./\s]+$"
RECOVERY_WORDS = ("recovered", "copy", "duplicate", "backup", "temp", "tmp")
TOKEN = "0-9a-z؀-ۿ"
TOKEN_GAP = f"[^{TOKEN}]+"
BIDI = "[‎‏‪-‮⁦-⁩]"


def latin_digits(name: Column) -> Column:
    """Arabic-Indic digits to 0-9."""
    return F.translate(name, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def strip_bidi(name: Column) -> Column:
    return F.regexp_replace(name, BIDI, "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Last suffix with its dot; empty for ``.bashrc`` and names without one."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def normalised(text: Column) -> Column:
    return strip_bidi(latin_digits(F.lower(text)))


#: Patterns in the order in which one decides, by their place in it: the longest first, in the order of the table among equals.
RANKED = {p: k for k, p in enumerate(sorted(IMPORTANCE, key=len, reverse=True))}
LATIN = [p for p in dict.fromkeys([*IMPORTANCE, *COPY_WORDS]) if re.fullmatch("[a-z]+", p)]
OTHERS = [p for p in dict.fromkeys([*IMPORTANCE, *COPY_WORDS]) if p not in LATIN]


def importance(name: Column) -> Column:
    text = normalised(name)
    return _importance(name, text, _found(text))


def _found(text: Column) -> Column:
    """All patterns of importance in a name: words of Latin letters that stand alone, and others anywhere."""
    return F.concat(matching.whole_words(text, LATIN, "a-z"), matching.anywhere(text, OTHERS))


def _importance(name: Column, text: Column, found: Column) -> Column:
    weights = F.array(*[F.lit(IMPORTANCE[p]) for p in RANKED])
    known = F.coalesce(F.try_element_at(weights, matching.least(found, RANKED) + 1), F.lit(5))
    base = F.when(F.regexp_replace(text, r"(?s)\.[^.]*$", "").rlike(CARVED), F.lit(5)).otherwise(known)
    numbered = text.rlike(NUMBERED) | text.rlike(ARABIC_NUMBERED)
    base = F.when(numbered | matching.any_of(found, COPY_WORDS), F.least(base, F.lit(3))).otherwise(base)
    return F.when(name.isNotNull(), F.when(numbered, base).otherwise(base + 1))


def evidence(rows: DataFrame, name: str = "name", name_date: Column | None = None) -> DataFrame:
    """``rows`` with ``importance`` and ``provenance`` of a name column, and
    with ``video_provenance`` if the name's date is given."""
    n = F.col(name)
    rows = rows.withColumns({"_text": normalised(n), "_stem": normalised(stem(n))})
    rows = rows.withColumns({"_words": _found(F.col("_text")), "_tokens": _markers(F.col("_stem"), ORIGINAL_MARKERS)})
    made = {
        "importance": _importance(n, F.col("_text"), F.col("_words")),
        "provenance": F.when(n.isNotNull(), _class(F.col("_stem"), ORIGINAL_MARKERS, image=True, found=F.col("_tokens"))),
    }
    if name_date is not None:
        rows = rows.withColumns({"_date": name_date, "_plain": latin_digits(F.lower(stem(n)))})
        rows = rows.withColumn("_parts", _markers(F.col("_plain"), VIDEO_ORIGINAL_MARKERS))
        made["video_provenance"] = _video_class(n, F.col("_plain"), F.col("_parts"), F.col("_date"))
    return rows.withColumns(made).drop("_text", "_stem", "_words", "_tokens", "_date", "_plain", "_parts")


def tokens(stem_text: Column) -> Column:
    return F.split(stem_text, TOKEN_GAP)


def _markers(stem_text: Column, original: list[str]) -> Column:
    """All markers among the words of a stem, with digits behind them or without."""
    return matching.marked_words(stem_text, [*RECOVERY_MARKERS, *COPY_MARKERS, *WEAK_MARKERS, *original], TOKEN)


def _class(text: Column, original: list[str], *, image: bool, found: Column | None = None) -> Column:
    found = _markers(text, original) if found is None else found
    lowered = [
        F.when(text.rlike(NUMBERED_END) & ~text.rlike(YEAR_END), F.lit(COPY)),
        F.when(matching.any_of(found, RECOVERY_MARKERS), F.lit(RECOVERED)),
        F.when(matching.any_of(found, COPY_MARKERS), F.lit(COPY)),
        F.when(matching.any_of(found, WEAK_MARKERS), F.lit(WEAK)),
    ]
    if image:
        lowered += [
            F.when(text.rlike(ARABIC_NUMBERED), F.lit(COPY)),
            F.when(text.rlike(CARVED), F.lit(RECOVERED)),
        ]
    worst = F.least(F.lit(NEUTRAL), *lowered)  # least skips nulls
    lifted = matching.any_of(found, original)
    return F.when((worst == NEUTRAL) & lifted, F.lit(ORIGINAL)).otherwise(worst)


def provenance(name: Column) -> Column:
    return F.when(name.isNotNull(), _class(normalised(stem(name)), ORIGINAL_MARKERS, image=True))


def video_provenance(name: Column, name_date: Column) -> Column:
    """As ``provenance`` without the carved shape, the Arabic counter and three
    markers; a stem that is nothing but a valid date, of digits and signs that
    part them, is an original."""
    text = latin_digits(F.lower(stem(name)))
    return _video_class(name, text, _markers(text, VIDEO_ORIGINAL_MARKERS), name_date)


def _video_class(name: Column, text: Column, found: Column, name_date: Column) -> Column:
    cls = _class(text, VIDEO_ORIGINAL_MARKERS, image=False, found=found)
    # digits and the signs that part them, and at least one digit
    dated = name_date.isNotNull() & text.rlike(DATE_ONLY) & text.rlike("[0-9]")
    return F.when(name.isNotNull(), F.when((cls == NEUTRAL) & dated, F.lit(ORIGINAL)).otherwise(cls))


def strip_collision(name: Column) -> Column:
    """``x_3.jpg`` back to ``x.jpg``; a name without a dot stays as it is."""
    return F.regexp_replace(name, r"(?s)^(.+)_\p{Nd}+(\.[^.]*)$", "$1$2")


def names_recovery(path: Column) -> Column:
    """Whether the file name holds one of the words anywhere."""
    return F.lower(base_name(path)).rlike("|".join(RECOVERY_WORDS))


def after_colon(line: Column) -> Column:
    """Trimmed text behind the first colon, null if there is none."""
    text = F.trim(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
    return F.when(text != "", text)


def human_size(size: Column) -> Column:
    """The same steps under short names, with two decimals."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.format_string("%.2f TB", size / F.lit(1024.0**4))
    for k in (3, 2, 1):
        out = F.when(F.abs(size) < 1024 ** (k + 1), F.format_string(f"%.2f {units[k]}", size / F.lit(1024.0**k))).otherwise(out)
    return F.when(F.abs(size) < 1024, F.format_string("%d B", size)).otherwise(out)


def human_bytes(size: Column) -> Column:
    """Binary units with one decimal."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    out = F.format_string("%.1f TiB", size / F.lit(1024.0**4))
    for k in (3, 2, 1):
        out = F.when(size < 1024 ** (k + 1), F.format_string(f"%.1f {units[k]}", size / F.lit(1024.0**k))).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size)).otherwise(out)
