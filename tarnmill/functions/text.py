"""Text cleaning, naming and detection as Column expressions; null counts as empty text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that Python's str.isspace accepts, as a Java character class (fixed values).
WS = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028-\u2029\u202F\u205F\u3000]"
#: The same class for RE2, which the SQL twins use.
WS_RE2 = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}-\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Control characters that cleaning drops (fixed values).
CONTROL = r"[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]"
#: Marker lines of numbered questions and of question and answer blocks (fixed values).
NUMBERED = r"(?U)^\s*(\d+)[\.\)]\s+"
QUESTION = r"(?iU)^\s*(q|question|問い|質問)[:：]\s*"
ANSWER = r"(?iU)^\s*(a|answer|回答|答え)[:：]\s*"
#: File kinds by substrings of format names and media types, in order of priority (fixed values).
KINDS = (("csv", ("csv",)), ("pdf", ("pdf",)), ("json", ("json",)), ("html", ("html",)), ("text", ("text", "txt")))

#: The characters of WS themselves, for trimming ends without a pattern.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

sub = F.regexp_replace


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space (any of Unicode's) at both ends."""
    return F.btrim(text(c), F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(sub(text(c), f"{WS}+", " "))


def newlines(c: Column) -> Column:
    return sub(text(c), r"\r\n?", "\n")


def trim_lines(c: Column) -> Column:
    """Every line stripped, blank ones left out."""
    lines = F.transform(F.split(newlines(c), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean_cell(c: Column) -> Column:
    """A table cell: no BOM, no control characters, blanks collapsed."""
    return strip(sub(sub(newlines(sub(text(c), "\ufeff", "")), CONTROL, ""), r"[ \t]+", " "))


def clean_text(c: Column) -> Column:
    """A text file: as a cell, and runs of twenty digits or more and of blank lines are cut down."""
    c = sub(newlines(sub(text(c), "\ufeff", "")), CONTROL, "")
    c = sub(sub(c, r"(?U)\d{20,}", " "), r"[ \t]+", " ")
    return strip(sub(c, r"\n{3,}", "\n\n"))


def pdf_line(c: Column) -> Column:
    """One line of a page: without line numbers, times and addresses, full stops and blanks folded."""
    c = strip(sub(strip(c), r"(?U)^\[\d+\]\s*", ""))
    c = strip(sub(c, r"(?U)\d{4}/\d{2}/\d{2}\s+\d{1,2}:\d{2}:\d{2}", ""))
    c = strip(sub(c, r"(?U)https?://\S+", ""))
    c = sub(sub(c, "[ ]{2,}", " "), r"(?U)[。．]\s*[。．]+", "。")
    return strip(sub(c, r"(?U)\s+([。．、，])", "$1"))


def is_noise_line(c: Column) -> Column:
    """Page numbers, roman numerals, layout file names and lines of symbols alone."""
    return (c == "") | c.rlike(r"(?i)\.indd") | c.rlike(r"(?U)^\d{1,4}$") | c.rlike("(?i)^[ivxlcdm]+$") | c.rlike(r"(?U)^[\s.\-–—・●○◯。､,，:：/／()（）]+$")


def clean_pdf(c: Column) -> Column:
    """A page's text: noisy lines dropped, ladders of numbers and long digits blanked, lines joined."""
    lines = F.transform(F.split(sub(newlines(c), CONTROL, ""), "\n"), pdf_line)
    c = F.array_join(F.filter(lines, lambda x: ~is_noise_line(x)), "\n")
    c = sub(sub(c, r"(?U)(?:\n?\d+){8,}", " "), r"(?U)\d{20,}", " ")
    c = sub(sub(c, r"[ \t]+", " "), r"(?<!\n)\n(?!\n)", " ")
    return strip(sub(c, r"\n{2,}", "\n"))


def chunk_input(c: Column) -> Column:
    """Text on its way into a chunk: no leading line number, wide gaps narrowed."""
    return strip(sub(strip(sub(strip(c), r"(?U)^\[\d+\]\s*", "")), r"(?U)\s{2,}", " "))


def is_front_matter(c: Column) -> Column:
    """Whether a page's text is a table of contents, a cover, a heading or too weak to use."""
    s, n = strip(c), F.length(strip(c))
    chapter = r"^第\s*[0-9０-９一二三四五六七八九十]+\s*"
    weak = r"(?U)^[\wぁ-んァ-ヶ一-龥・。．、，\-\s]+$"
    return (
        (s == "") | s.rlike(r"目\s*次") | s.rlike(r"[\.．・]{4,}|…{2,}") | ((n <= 200) & s.rlike("提出|表紙|この用紙は|食育推進施策"))
        | ((n <= 120) & (s.rlike(chapter + r"[章節][^\n]*$") | s.rlike(r"^図表[0-9０-９\-－—―\.]+[^\n]*$"))) | ((n <= 20) & s.rlike(weak))
    )


def lines_of(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text(c), "\n"), strip), lambda x: x != "")


def marker_counts(c: Column) -> tuple[Column, Column]:
    """Numbered question lines, and question or answer marker lines."""
    lines = lines_of(c)
    return F.size(F.filter(lines, lambda x: x.rlike(NUMBERED))), F.size(F.filter(lines, lambda x: x.rlike(QUESTION) | x.rlike(ANSWER)))


def text_kind(c: Column) -> Column:
    """quiz, qa or paragraph: which splitter a text asks for."""
    quiz, qa = marker_counts(c)
    return F.when(quiz >= 2, "quiz").when(qa >= 2, "qa").otherwise("paragraph")


def line_count(c: Column) -> Column:
    return F.size(lines_of(c))


def first_text(columns: Sequence[Column], default: str | None = None) -> Column:
    """The first column that is neither null nor empty."""
    found = [F.nullif(c.cast("string"), F.lit("")) for c in columns]
    return F.coalesce(*found, F.lit(default)) if default is not None else F.coalesce(*found)


def logical_name(house: Column, meeting: Column, issue_id: Column, default: str = "unnamed") -> Column:
    empty = F.lit("")
    return first_text([F.concat_ws(" / ", F.nullif(text(house), empty), F.nullif(text(meeting), empty)), issue_id], default)


def labelled(parts: Sequence[tuple[str, Column]]) -> Column:
    """Lines `label: value` of the values that are not empty."""
    return F.concat_ws("\n", *[F.when(text(c) != "", F.concat(F.lit(f"{label}: "), text(c))) for label, c in parts])


def extension(url: Column) -> Column:
    """The last dot's suffix of an address's last path segment, in lower case; empty without one."""
    path = F.regexp_extract(text(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def base_name(url: Column) -> Column:
    """The unquoted last path segment; a segment that cannot be unquoted stays as it is."""
    path = F.regexp_extract(text(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    raw = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def content_kind(*hints: Column) -> Column:
    """csv, pdf, json, html or text by the first kind that any hint names; empty if none does."""
    lowered = [F.lower(text(h)) for h in hints]
    found = F.lit("")
    for kind, names in reversed(KINDS):
        test = F.lit(False)
        for h in lowered:
            for name in names:
                test = test | h.contains(name)
        found = F.when(test, kind).otherwise(found)
    return found


def is_object_path(c: Column) -> Column:
    s = strip(c)
    return s.startswith("users/") | s.startswith("template/") | ((F.regexp_count(s, F.lit("/")) >= 2) & F.element_at(F.split(s, "/"), -1).contains("."))


def dataset_id(id_: Column, name: Column) -> Column:
    """A dataset's id: its own, or its name."""
    return collapse(first_text([id_, name], ""))


def dataset_title(title: Column, name: Column, id_: Column, default: str = "オープンデータ") -> Column:
    return collapse(first_text([title, name, id_], default))


def resource_extension(declared: Column, url: Column) -> Column:
    """A resource's declared format in lower case, or its address's suffix where none is declared."""
    return F.coalesce(F.nullif(F.lower(collapse(declared)), F.lit("")), extension(url))


def upload_extension(ext: Column) -> Column:
    """An upload's suffix in lower case; `text` is `txt`."""
    s = F.lower(strip(ext))
    return F.when(s == "text", "txt").otherwise(s)


#: Media types by suffix (fixed values); anything else is a stream of bytes.
MEDIA_TYPES = {
    "opendata": {"pdf": "application/pdf", "csv": "text/csv; charset=utf-8", "json": "application/json; charset=utf-8"},
    "upload": {"txt": "text/plain; charset=utf-8", "text": "text/plain; charset=utf-8", "log": "text/plain; charset=utf-8", "md": "text/plain; charset=utf-8", "json": "application/json", "csv": "text/csv; charset=utf-8", "pdf": "application/pdf"},
}


def media_type(ext: Column, source: str) -> Column:
    """The media type that a download of a source's file is sent as."""
    found = F.lit("application/octet-stream")
    for suffix, kind in MEDIA_TYPES[source].items():
        found = F.when(F.lower(text(ext)) == suffix, kind).otherwise(found)
    return found


def record_text(kind: Column, record: Column, body: Column) -> Column:
    """A record as text: a table row's cells as pairs, the text of any other."""
    return F.when(kind == "csv", pairs_text(record)).otherwise(text(body))


def pairs_text(record: Column) -> Column:
    """A map of cells as `key: value | key: value`; pairs with neither are left out."""
    entries = F.filter(F.map_entries(record), lambda e: (strip(e["key"]) != "") | (strip(e["value"]) != ""))
    return F.array_join(F.transform(entries, lambda e: F.concat(strip(e["key"]), F.lit(": "), strip(e["value"]))), " | ")


def title_of(*columns: Column) -> Column:
    return F.substring(F.coalesce(*[F.nullif(collapse(c), F.lit("")) for c in columns], F.lit("")), 1, 120)


def preview(answer: Column, content: Column, most: int = 300) -> Column:
    return F.substring(first_text([answer, content], ""), 1, most)


def as_int(c: Column, default: int) -> Column:
    """A whole number, or the default where it is none; fractions are cut off, texts with a point are none."""
    return F.coalesce(F.when(c.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c.cast("string")).try_cast("long")), F.lit(default).cast("long"))


#: A whole string, or what stands between strings, or a quote that nothing closes; the loops never step back, so length is no matter.
JSON_RUNS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'


def repair_json(c: Column) -> Column:
    """The JSON in a model's reply: fences and lead-in dropped, trailing commas and bare keys mended.

    Strings are told from what stands between them, and only the latter is mended, so valid JSON comes back as it was.
    """
    s = sub(sub(strip(c), r"^```[^\n]*\n?", ""), r"\n?```\s*$", "")
    s = F.regexp_extract(sub(strip(s), "(?i)^json", ""), r"(?s)([\{\[].*)", 1)
    mended = lambda x: sub(sub(x, r",(\s*[}\]])", "$1"), r"([{\[,]\s*)([A-Za-z_][A-Za-z0-9_]*)(\s*:)", '$1"$2"$3')
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(JSON_RUNS), F.lit(0)), lambda x: F.when(x.startswith('"'), x).otherwise(mended(x))), "")
