"""Text expressions: normalising, bullets, headings, sentences, evidence.  All are Spark columns.

The only Python is NFC composition, which Spark lacks; all texts pass through it in Arrow batches.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fitloom.functions import patterns as PT
from fitloom.functions import vocab as V

#: White space of any script, as Unicode ranges.
WHITE = "[" + "".join(chr(a) + "-" + chr(b) for a, b in ((9, 13), (28, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))) + "]"


def let(col: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(col), body), F.lit(0))


def nfc(col: Column) -> Column:
    """Unicode NFC composition, Arrow-batched."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return compose(col)


def strip(col: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col, rf"^{WHITE}+|{WHITE}+$", "")


def normalize_text(col: Column, compose: bool = True) -> Column:
    """Uniform line ends, no invisible characters, half-width letters and technical symbols, plain dashes and quotes,
    lines without trailing white space and at most one blank line in a row."""
    t = F.coalesce(col, F.lit(""))
    if compose:
        t = nfc(t)
    t = F.regexp_replace(t, r"\r\n?", "\n")
    # Characters without a counterpart are dropped.
    t = F.translate(t, "".join(V.MAPPED) + V.INVISIBLE, "".join(V.MAPPED.values()))
    t = F.regexp_replace(t, rf"(?:(?!\n){WHITE})+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\n+|\n+\z", "")


def is_bullet(col: Column) -> Column:
    return col.rlike(PT.BULLET)


def strip_bullet(col: Column) -> Column:
    return strip(F.regexp_replace(col, PT.BULLET, ""))


def strip_list_prefix(col: Column) -> Column:
    """A phrase without the number that a list gave it."""
    return strip(F.regexp_replace(F.coalesce(col, F.lit("")), r"^\(?\d{1,2}\)?\s*[.、)）]?\s*", ""))


def indentation(col: Column) -> Column:
    """Width of the leading blanks, a tab counting four."""
    lead = F.regexp_extract(col, r"^[ \t]*", 0)
    return F.length(lead) + 3 * F.length(F.regexp_replace(lead, " ", ""))


def clean_heading(col: Column) -> Column:
    """A heading without hashes, emphasis, brackets, numbering and final colon."""
    t = strip(col)
    for pattern, by in (
        (r"^#{1,6}\s*", ""),
        (r"^\*\*(.+?)\*\*$", "$1"),
        (r"^__(.+?)__$", "$1"),
        (r"^[【\[（(](.+?)[】\]）)]$", "$1"),
        (r"^[一二三四五六七八九十]{1,3}\s*[、.．]\s*", ""),
        (r"^第[一二三四五六七八九十]{1,3}部分\s*[：:]?\s*", ""),
        (r"[：:]\s*$", ""),
    ):
        t = F.regexp_replace(t, pattern, by)
    return strip(t)


def strip_trailing_paren(col: Column) -> Column:
    for _ in range(3):
        col = strip(F.regexp_replace(col, r"[（(][^）)]{0,14}[）)]\s*$", ""))
    return col


def split_sentences(col: Column) -> Column:
    """Sentences, cut at sentence ends, line ends and full stops before white space or the end."""
    parts = F.split(F.coalesce(col, F.lit("")), rf"[{V.SENTENCE_END}]|\.(?=\s|$)|\n+")
    trim = lambda x: F.regexp_replace(strip(x), r"^[ \t·•-]+|[ \t·•-]+$", "")
    return F.filter(F.transform(parts, trim), lambda x: F.length(x) > 0)


def split_blocks(col: Column, most: int = 220) -> Column:
    """Lines without bullets; longer ones are cut into sentences that are packed again up to ``most`` characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), "\n"), lambda x: strip_bullet(strip(x))), lambda x: F.length(x) > 0)

    def pack(line: Column) -> Column:
        empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

        def add(acc: Column, s: Column) -> Column:
            full = (F.length(acc["held"]) > 0) & (F.length(acc["held"]) + F.length(s) > most)
            return F.struct(
                F.when(full, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"]).alias("done"),
                F.when(full | (F.length(acc["held"]) == 0), s).otherwise(F.concat(acc["held"], F.lit(" "), s)).alias("held"),
            )

        return F.aggregate(split_sentences(line), empty, add, lambda a: F.when(F.length(a["held"]) > 0, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]))

    return F.flatten(F.transform(lines, lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(pack(x))))


def shorten(col: Column, most: int = 60, suffix: str = "...") -> Column:
    t = strip(F.coalesce(col, F.lit("")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(max(0, most - len(suffix)))), F.lit(suffix)))


def has_quantified(col: Column) -> Column:
    """Whether a text holds a percentage, a number with a unit or a metric with a number."""
    found = F.lit(False)
    for p in PT.QUANTITIES:
        found = found | col.rlike(p)
    return F.coalesce(found, F.lit(False))


def count_numbers(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"(?<![0-9.])[0-9]+(?:\.[0-9]+)?(?![0-9.])"))


def char_class(chars: str) -> str:
    return "".join("\\" + c if c in r"\[]^-&" else c for c in chars)


def tail(col: Column, inside: str) -> Column:
    """The characters of a class that a text ends with, sought backwards: a search for a text's end tries every place and takes the square of its length."""
    return F.reverse(F.regexp_extract(F.reverse(col), f"^{inside}*", 0))


def evidence_around(text: Column, start: Column, end: Column, span: int = 40) -> Column:
    """The text around [start, end) up to ``span`` characters, aligned to sentence and line ends, at most 160 long."""
    ends = char_class(V.SENTENCE_END + "\n")
    low = F.greatest(F.lit(0), start - span)
    left = tail(F.substr(text, low + 1, start - low), f"[^{ends}]")
    right = F.regexp_extract(F.substr(text, end + 1, F.lit(span)), rf"^[^{ends}]*[{ends}]?", 0)
    t = F.regexp_replace(strip(F.concat(left, F.substr(text, start + 1, end - start), right)), rf"{WHITE}+", " ")
    return F.when(F.length(t) > 160, F.concat(F.left(t, F.lit(157)), F.lit("..."))).otherwise(t)


def context_phrase(text: Column, index: Column, length: Column, left: int = 6, right: int = 5) -> Column:
    """A word with up to ``left`` and ``right`` characters around it, not across a phrase border."""
    inside = f"[^{char_class(V.PHRASE_BORDER)}]"
    low = F.greatest(F.lit(0), index - left)
    before = tail(F.substr(text, low + 1, index - low), inside)
    after = F.regexp_extract(F.substr(text, index + length + 1, F.lit(right)), rf"^{inside}*", 0)
    return strip(F.concat(before, F.substr(text, index + 1, length), after))


def clause_at(text: Column, start: Column, end: Column) -> Column:
    """The clause of a line around [start, end): between the nearest borders; enumeration commas don't count."""
    borders = char_class(V.CLAUSE_BORDER + "\n")
    before = tail(F.substr(text, F.lit(1), start), f"[^{borders}]")
    after = F.regexp_extract(F.substr(text, end + 1), rf"^[^{borders}]*", 0)
    return strip(F.concat(before, F.substr(text, start + 1, end - start), after))


def join_names(names: Column, most: int) -> Column:
    """"A、B 等 N 项"; 无 for none."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, most), "、")
    return F.when(n <= 0, F.lit("无")).when(n <= most, head).otherwise(F.concat(head, F.lit(" 等 "), n.cast("string"), F.lit(" 项")))


def mask_secret(col: Column) -> Column:
    """A secret's first and last characters only; short ones are hidden whole."""
    n = F.length(col)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("")).when(n <= 8, F.lit("****")).otherwise(F.concat(F.left(col, F.lit(4)), F.lit("****"), F.right(col, F.lit(4))))


def find_span(text: Column, word: Column | str) -> Column:
    """0-based position of a word (a column or a plain string) whatever its case, -1 where it doesn't occur."""
    return F.position(F.lower(F.lit(word) if isinstance(word, str) else word), F.lower(text)) - 1


def clean_list(col: Column, most_chars: int = 60, most: int = 40) -> Column:
    """A separated text as names: trimmed, unquoted, without repeats whatever their case, without overlong ones."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), r"[,，、;；\n|]"), lambda x: F.regexp_replace(F.regexp_replace(strip(x), r"""^["'“”]+|["'“”]+$""", ""), rf"{WHITE}+", " "))
    kept = F.filter(parts, lambda x: (F.length(x) > 0) & (F.length(x) <= most_chars))
    # Sorted by name, repeats stand together, the first of the text in front; those stay, and go back to their order.
    by_name = F.array_sort(F.transform(kept, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = let(by_name, lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"])))
    return F.slice(F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"]), 1, most)
