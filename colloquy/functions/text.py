"""Column expressions over titles, messages and times."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Beginnings of messages that say nothing about a session.
NOISE = ("<command-message>", "<local-command-caveat>", "# New session -")
UNTITLED = "Untitled"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: str | Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Latin letters with marks, their plain letters, and then the marks themselves, which translate to nothing."""
    src, dst = "", ""
    for code in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFD", chr(code))[0]
        if plain != chr(code):
            src, dst = src + chr(code), dst + plain
    return src + "".join(map(chr, range(0x300, 0x370))), dst


def fold(c: str | Column) -> Column:
    """Lower case, without diacritics."""
    return F.lower(F.translate(col(c), *_accents()))


def tokens(c: str | Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.array_remove(F.split(fold(c), r"[^\p{L}\p{N}\p{Co}]+"), "")


def is_noise(c: str | Column) -> Column:
    text = F.regexp_replace(col(c), r"(?U)^\s+", "")
    out = F.lit(False)
    for start in NOISE:
        out = out | text.startswith(start)
    return out


def cut(c: str | Column, most: int, mark: str = "...") -> Column:
    """Texts over most characters end in the mark, within most characters."""
    c = col(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(mark)), F.lit(mark))).otherwise(c)


def title(first: str | Column) -> Column:
    """A session's title from its first telling user message."""
    text = trim(F.coalesce(col(first), F.lit("")))
    return F.when(text == "", UNTITLED).otherwise(cut(text, 80))


def first_user_message(role: str = "role", content: str = "content", seq: str = "seq") -> Column:
    """Aggregate: the first user message that is no noise, else the first user message."""
    user = F.col(role) == "user"
    telling = user & ~is_noise(content)
    return F.coalesce(F.min_by(content, F.when(telling, F.col(seq))), F.min_by(content, F.when(user, F.col(seq))))


def embedding_text(title_col: str | Column, content: str | Column) -> Column:
    return F.substring(F.concat(col(title_col), F.lit(": "), col(content)), 1, 500)


def snippet(c: str | Column, size: int = 200) -> Column:
    return F.substring(col(c), 1, size)


def sanitize(c: str | Column) -> Column:
    """A line with tabs as four spaces and no control characters."""
    return F.regexp_replace(F.replace(col(c), F.lit("\t"), F.lit("    ")), r"\p{Cc}", "")


def flatten(c: str | Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)\s+", " "), "^ | $", "")


def age_label(then_ms: str | Column, as_of_ms: int) -> Column:
    """<1h, hours, days, months of 30 days."""
    hours = F.floor(F.greatest(F.lit(as_of_ms) - col(then_ms), F.lit(0)) / 3_600_000)
    days = F.floor(hours / 24)
    return F.when(hours < 1, "<1h").when(hours < 24, F.concat(hours, F.lit("h"))).when(days < 30, F.concat(days, F.lit("d"))).otherwise(F.concat(F.floor(days / 30), F.lit("mo")))


def relative_cutoff(c: str | Column, as_of_ms: int) -> Column:
    """Epoch ms of "3d", "2w" or "1m" (30 days) before as_of_ms; null for anything else."""
    text = trim(col(c))
    n = F.regexp_extract(text, r"^(\d{1,6})([dwm])$", 1)
    unit = F.regexp_extract(text, r"^(\d{1,6})([dwm])$", 2)
    days = F.when(unit == "d", 1).when(unit == "w", 7).when(unit == "m", 30)
    return F.lit(as_of_ms) - F.when(n != "", n).cast("bigint") * days * DAY_MS


def message_time(c: str | Column) -> Column:
    """month-day hour:minute, empty for null (session time zone)."""
    return F.coalesce(F.date_format(F.timestamp_millis(col(c)), "MM-dd HH:mm"), F.lit(""))


def day(c: str | Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(col(c)), "yyyy-MM-dd"), F.lit("-"))


def date_range(oldest: str | Column, newest: str | Column) -> Column:
    return F.concat(day(oldest), F.lit(" -> "), day(newest))


def rfc3339_ms(c: str | Column) -> Column:
    """Epoch ms of an RFC 3339 time; null for anything else."""
    c = col(c)
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.unix_millis(F.try_to_timestamp(F.upper(c))))


def decode_directory(c: str | Column) -> Column:
    """Path of a directory key: a leading - goes, -- is /., - is /."""
    key = F.regexp_replace(col(c), "^-", "")
    return F.concat(F.lit("/"), F.replace(F.replace(key, F.lit("--"), F.lit("/.")), F.lit("-"), F.lit("/")))


def percentage(part: str | Column, whole: str | Column) -> Column:
    return F.when(col(whole) == 0, 0.0).otherwise(col(part) * 100.0 / col(whole))


def match_offsets(line: str | Column, needle: str) -> Column:
    """Starts of the needle in a line, in code points, without regard to case, left to right and apart; none where lower case changes the line's byte length."""
    line = col(line)
    low, find = F.lower(line), needle.lower()
    if not find:
        return F.array().cast("array<int>")
    pieces = F.split(low, "\\Q" + find.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    step = F.lit(len(find))
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
    walked = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1), start,
        lambda a, p: F.struct(F.array_append(a["out"], a["at"] + F.length(p)).alias("out"), (a["at"] + F.length(p) + step).alias("at")),
    )["out"]
    return F.when(F.octet_length(low) == F.octet_length(line), walked).otherwise(F.array().cast("array<int>"))


def contains_line(content: str | Column, needle: str) -> Column:
    """Whether any sanitised line holds the needle, without regard to case."""
    return F.exists(F.split(col(content), "\n"), lambda line: F.contains(F.lower(sanitize(line)), F.lit(needle.lower())))


def export_name(label: str | Column, title_col: str | Column) -> Column:
    """File name of a transcript: label and 40 characters of the title, only letters, digits, - and _."""
    return F.concat(col(label), F.lit("-"), F.regexp_replace(F.substring(col(title_col), 1, 40), r"[^\p{L}\p{N}_-]", "_"), F.lit(".txt"))


def rewrite_query(text: str) -> list[list[str]]:
    """Words of a keyword query, each as the tokens that must stand in a row.

    Split at white space; all but letters, digits and _ deleted; lower case. Words stay repeated; a word that holds no token
    matches nothing."""
    src, dst = _accents()
    table = {ord(a): dst[i] if i < len(dst) else None for i, a in enumerate(src)}
    words = ["".join(c for c in w if c.isalnum() or c == "_").lower() for w in text.split()]
    return [[t for t in w.translate(table).split("_") if t] for w in words if w]


def query_words(c: str | Column) -> Column:
    """rewrite_query for a column of queries: an array of words, each the tokens that must stand in a row; words without a token are left out."""
    words = F.transform(F.split(col(c), r"(?U)\s+"), lambda w: tokens(F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")))
    return F.filter(words, lambda w: F.size(w) > 0)
