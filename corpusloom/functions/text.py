"""Text functions over columns: cleaning of one line or text, and predicates on lines.

All are built-in expressions, so they stay in the JVM and inside whole-stage code generation. Regular
expressions carry (?U) so that classes and word boundaries are Unicode's, and (?iu) where case is folded.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------------
LINE_ENDS = r"\r\n|[\r\x0B\x85\u2028\u2029]"
REMOVED = r"[\u200B\u200C\u200D\u2060\uFEFF\u00AD\x00-\x08\x0B\x0E-\x1F\x7F-\x9F]"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LIGATURES = (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st"))
LEADER = r"[._]{4,}|(?:[.·] ){3,}[.·]"
RULE_RUN = r"([-=*~#•·])\1{3,}"
COLUMN_GAP = r"[ \t]*\t[ \t]*| {3,}"
PAGE_NUMBER = (
    r"^(?:(?:seite|page|blatt|pg\.?)\s*:?\s*\d{1,4}(?:\s*(?:von|of|/)\s*\d{1,4})?|(?:s\.|p\.)\s*\d{1,4}\s*(?:von|of|/)\s*\d{1,4}"
    r"|\d{1,4}\s+(?:von|of)\s+\d{1,4}|[-–—]\s*\d{1,4}\s*[-–—])$"
)
EDGE_NUMBER = r"^(\d{1,4})(?:\s*/\s*(\d{1,4}))?$"
PAGE_TOKEN = r"\b(?:seite|page|blatt)\b"
COUNTER_END = r"\b\d{1,4}\s*/\s*\d{1,4}$"
URL_OR_MAIL = r"(?:www\.|https?:|\S+@)"
TOC_ENTRY = (
    r"^((?:§\s*\d+[a-z]?|art(?:ikel|icle)?\.?\s*\d+|anlage\s+\d+|annex\s+\d+|abschnitt\s+\d+"
    r"|\d{1,2}(?:\.\d{1,2})*\.?|[IVX]{1,5}\.)\s+\S.{0,100}?)\s*\.\.\.\s*(\d{1,4})$"
)
MEANINGFUL = "§€$£%☐☑☒✓✔✗✘■□"
VALUE = (
    r"\d[\d.,']*\s?(?:€|eur\b|euro\b|chf\b|usd\b|\$|%)|(?:€|eur\b|chf\b|usd\b|\$)\s?\d"
    r"|\b\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2})\b|\b\d{4}-\d{2}-\d{2}\b"
    r"|\b\d+\s*(?:tag|tage|tagen|woche|wochen|monat|monate|monaten|jahr|jahre|jahren|days?|weeks?|months?|years?)\b|§\s*\d"
)
INTERVALS = (
    "täglich", "wöchentlich", "monatlich", "quartalsweise", "vierteljährlich", "halbjährlich", "jährlich", "einmalig",
    "daily", "weekly", "monthly", "quarterly", "annually", "yearly",
)
LETTERS = "A-Za-zÄÖÜäöüß"
HYPHEN_END = rf"(?<![{LETTERS}])([{LETTERS}]{{2,}})[-‐‑]$"
LIST_MARKER = r"^(?:[a-z]|[ivx]{1,4})[).]\s"
HEADING_START = r"^(?:§\s*\d|art(?:ikel|icle)?\.?\s*\d|\d{1,2}(?:\.\d{1,2})*\.?\s+\S|[IVX]{1,5}\.\s)"
FIELD_LABEL = r"^[^\s:]{1,30}(?: [^\s:]{1,30}){0,3}:(?:\s|$)"
LOWER_WORD = rf"^[a-zäöüß][{LETTERS}]*$"
ARTICLES = ("Der", "Die", "Das", "Den", "Dem", "Des", "Ein", "Eine", "Einer", "Eines", "Einem", "Einen", "The")
NUMBER = r"^\d[\d.,]*$"
UNIT_WORDS = (
    "Tag", "Tage", "Tagen", "Werktage", "Werktagen", "Kalendertage", "Kalendertagen", "Woche", "Wochen", "Monat", "Monate",
    "Monaten", "Jahr", "Jahre", "Jahren", "Stunden", "Euro", "EUR", "Prozent",
)
CONJUNCTIONS = ("und", "oder", "bzw", "beziehungsweise", "sowie", "bis", "als", "wie", "and", "or", "nor")
#: Characters a token takes on average; the part of a window that is planned; what output takes.
CHARS_PER_TOKEN, WINDOW_RATIO, OUTPUT_TOKENS, OUTPUT_TOKENS_V4, LEAST_BUDGET = 3.2, 0.9, 512, 768, 1500
# ----------------------------------------------------------------------------------------------------------


def folded(pattern: str) -> str:
    return "(?iuU)" + pattern


def exact(pattern: str) -> str:
    return "(?U)" + pattern


def has_any(text: Column, literals: tuple[str, ...]) -> Column:
    """Whether a text holds one of some literals: far cheaper than a regular expression, so expressions are tried behind it."""
    return reduce(or_, (F.contains(text, F.lit(x)) for x in literals))


def _folds() -> dict[str, str]:
    """Characters that patterns regardless of case take for another one than their lower case."""
    every = [chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000]
    found = {c: c.upper().lower() for c in every if len(c.upper()) == 1 and len(c.upper().lower()) == 1 and c.upper().lower() != c.lower()}
    return found | {"\u0130": "i", "\u03a3": "\u03c3"}  # lower case makes two characters of the one, and looks at what follows the other


_FOLDS = _folds()
_FOLD_TABLE, _FOLDED = str.maketrans(_FOLDS), re.compile(f"[{''.join(_FOLDS)}]")
#: What the bytes of all these begin with, but for no dash, quote, euro sign or letter of Latin-1: without any, lower case is all.
_FOLD_BYTES = sorted({b"\xc2\xb5", *(c.encode()[:1] for c in _FOLDS if c != "µ")})


def fold_case(text: Column) -> Column:
    """Text in which a pattern in lower case matches at the places where it matches regardless of case: one character for each."""
    raw = text.cast("binary")
    odd = reduce(or_, (F.contains(raw, F.lit(x)) for x in _FOLD_BYTES))
    return F.lower(F.when(odd, F.translate(text, "".join(_FOLDS), "".join(_FOLDS.values()))).otherwise(text))


def fold(literal: str) -> str:
    """fold_case of one string."""
    return (literal.translate(_FOLD_TABLE) if not literal.isascii() and _FOLDED.search(literal) else literal).lower()


@cache
def _word_class() -> str:
    """The characters that word boundaries of (?U) lie between, as a class; Python's own take powers and fractions for letters, and marks for none."""
    own = lambda i: unicodedata.category(chr(i)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Me", "Mc", "Nd", "Nl", "Pc") or 0x24B6 <= i <= 0x24E9
    out, begin = [], None
    for i in range(0x10001):
        inside = i < 0x10000 and own(i)
        if inside and begin is None:
            begin = i
        elif not inside and begin is not None:
            out.append(f"\\u{begin:04x}-\\u{i - 1:04x}")
            begin = None
    return "(?:[" + "".join(out) + r"]|(?![\0-\uffff])\w)"


def compiled(pattern: str, flags: int = 0) -> re.Pattern:
    """A pattern of (?U) for Python, whose \\b is that of the JVM."""
    word = _word_class()
    # before a digit or a letter a boundary is no more than the end of what isn't a word; that the letter is there is seen first, as it's cheaper
    pattern = re.sub(r"\\b(\\d|[a-z])", lambda m: f"(?={m[1]})(?<!{word}){m[1]}", pattern)
    return re.compile(pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"), flags)


def unify_line_ends(text: Column) -> Column:
    """Every line separator as a line feed; form feeds stay."""
    return F.regexp_replace(text, LINE_ENDS, "\n")


def clean_characters(text: Column) -> Column:
    """Invisible and control characters go, odd spaces become spaces, ligatures letters."""
    out = F.translate(F.regexp_replace(text, REMOVED, ""), SPACES, " " * len(SPACES))
    for mark, letters in LIGATURES:
        out = F.replace(out, F.lit(mark), F.lit(letters))
    return out


#: A text without any of these is clean: one scan instead of ten. Single characters of Latin-1 cost one look at a bit, every range a call.
_UNCLEAN = "[" + "".join(f"\\x{c:02X}" for c in (*range(9), 11, *range(13, 32), *range(0x7F, 0xA1), 0xAD)) + r"\u1680\u2000-\u200F\u2028-\u2060\u3000\uFB00-\uFEFF]"


def clean_text(text: Column) -> Column:
    """N1-N4 of a text that isn't null."""
    return F.when(text.rlike(_UNCLEAN), clean_characters(unify_line_ends(text))).otherwise(text)


#: Every leader, rule run and column gap holds one of these, and shortening one makes none of the others.
_COLLAPSIBLE = ("..", "__", "._", "_.", ". .", ". ·", "· .", "· ·", *(c * 2 for c in "-=*~#•·"), "\t", "   ")


def collapse_line(line: Column) -> Column:
    """Leaders, rule runs and column gaps shortened, ends trimmed."""
    out = F.regexp_replace(line, LEADER, "...")
    out = F.regexp_replace(out, RULE_RUN, "$1$1$1")
    out = F.regexp_replace(out, COLUMN_GAP, "  ")
    return F.trim(F.when(has_any(line, _COLLAPSIBLE), out).otherwise(line))


def squeeze(text: Column) -> Column:
    """Every run of white space as one space; single spaces aren't touched."""
    return F.regexp_replace(text, exact(r"\s{2,}|[\s&&[^ ]]"), " ")


def edge_key(line: Column, page_counter: bool) -> Column:
    """Lower case, squeezed; digits as # where the line counts pages."""
    key = squeeze(F.lower(line))
    counts = line.rlike(folded(PAGE_TOKEN))
    if page_counter:
        counts = counts | line.rlike(exact(COUNTER_END))
    return F.when(counts, F.regexp_replace(key, exact(r"\d+"), "#")).otherwise(key)


def toc_key(text: Column) -> Column:
    """N11."""
    return F.lower(F.trim(squeeze(text)))


def meaningful_chars(text: Column) -> Column:
    """Letters and digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")).cast("long")


#: Fixed value: what counts as a concrete value of a block.
VALUE_KEYS = (
    r"\d[\d.,']*\s?(?:€|eur\b|euro\b|chf\b|usd\b|\$|%)|(?:€|eur\b|chf\b|usd\b|\$)\s?\d[\d.,']*"
    r"|\b\d+\s*(?:tag|woche|monat|jahr|day|week|month|year)|\b\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2})\b|\b\d{4}-\d{2}-\d{2}\b"
    r"|\b(?=[A-Z0-9/-]*\d)[A-Z][A-Z0-9/-]{3,}\b"
)


def value_keys(text: Column) -> Column:
    """The distinct values a text names, lower case and without white space."""
    found = F.regexp_extract_all(text, F.lit(folded(VALUE_KEYS)), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, exact(r"\s+"), ""))))


def token_estimate(chars: Column) -> Column:
    """N14."""
    return (F.floor(chars / F.lit(CHARS_PER_TOKEN)) + 1).cast("int")


def call_budget(window: Column, overhead_chars: Column, output_tokens: int = OUTPUT_TOKENS) -> Column:
    """The characters of text that one call may carry."""
    room = window * F.lit(WINDOW_RATIO) - token_estimate(overhead_chars) - output_tokens
    return F.greatest(F.lit(LEAST_BUDGET), F.floor(room * F.lit(CHARS_PER_TOKEN)).cast("int"))


def serial_key(text: Column) -> Column:
    """Upper case without white space and - . / _."""
    return F.upper(F.regexp_replace(text, exact(r"[\s\-./_]+"), ""))


def scalar_key(text: Column) -> Column:
    """N24 for strings: squeezed, trimmed and case-folded."""
    return F.lower(F.upper(F.trim(squeeze(text))))


def german_money(amount: Column) -> Column:
    """Two decimals, rounded half to even, 1.234,56."""
    return F.translate(F.format_number(F.bround(amount, 2), 2), ",.", ".,")


def meaningful(text: Column, least: int = 30) -> Column:
    """P1."""
    return meaningful_chars(text) >= least


def is_page_number(line: Column) -> Column:
    """P2."""
    return line.rlike(folded(PAGE_NUMBER))


def is_symbol_noise(line: Column) -> Column:
    """Hardly a letter or digit and no symbol that means something by itself."""
    plain, size = meaningful_chars(line), F.length(line)
    return (size > 0) & ~has_any(line, tuple(MEANINGFUL)) & (plain < F.when(size >= 6, F.lit(0.25) * size).otherwise(F.lit(1.0)))


def is_protected_value(line: Column) -> Column:
    """P5: amounts, dates, durations and intervals, unless the line counts pages."""
    interval = F.lower(F.rtrim(F.regexp_replace(line, r"[.,;]+$", ""))).isin(*INTERVALS)
    value = line.rlike(exact(r"\d")) & line.rlike(folded(VALUE))  # every value has a digit
    return (value | interval) & ~line.rlike(folded(PAGE_TOKEN))


def is_table_like(line: Column) -> Column:
    """P6."""
    return line.contains("|") | line.contains("  ")


def may_be_header(line: Column) -> Column:
    """P7."""
    starts = ~line.rlike(exact(r"^\p{Ll}")) | line.rlike(folded("^" + URL_OR_MAIL))
    return line.rlike(folded(PAGE_TOKEN)) | (~line.rlike(r"[.!?;:,]$") & starts)


def is_heading_start(line: Column) -> Column:
    """P9."""
    return line.rlike(folded(HEADING_START))


def is_list_marker(line: Column) -> Column:
    """P10."""
    return line.rlike(LIST_MARKER)


def is_field_label(line: Column) -> Column:
    """P11."""
    return line.rlike(exact(FIELD_LABEL))


def ends_mid_sentence(line: Column, following: Column) -> Column:
    """Line ends on a lower-case word, an article, or a number whose unit begins the following line."""
    last = F.substring_index(line, " ", -1)
    unit = F.regexp_replace(F.substring_index(following, " ", 1), "[.,;]+$", "").isin(*UNIT_WORDS)
    return last.rlike(LOWER_WORD) | last.isin(*ARTICLES) | (last.rlike(NUMBER) & unit)


JOIN_NONE, JOIN_SPACE, JOIN_HYPHEN, JOIN_WORD = "none", "space", "hyphen", "word"
#: Of wrap_kind: a space if the logical line is long enough, else none.
JOIN_LOWER = "lower"
#: A logical line of so many characters goes on in lower case (fixed value).
JOIN_CHARS = 30


def long_enough(logical_chars: Column) -> Column:
    """What JOIN_LOWER comes to in a logical line of so many characters."""
    return F.when(logical_chars >= JOIN_CHARS, JOIN_SPACE).otherwise(JOIN_NONE)


def wrap_join(line: Column, following: Column, logical_chars: Column) -> Column:
    """How the following physical line continues line: none, space, hyphen (kept) or word (hyphen dropped)."""
    return _wrap(line, following, long_enough(logical_chars))


def wrap_kind(line: Column, following: Column) -> Column:
    """P13 where the logical line's length isn't known yet: JOIN_LOWER where it decides."""
    return _wrap(line, following, F.lit(JOIN_LOWER))


def _wrap(line: Column, following: Column, in_lower: Column) -> Column:
    letter = following.rlike(r"^\p{L}")
    hyphenated = F.when(line.isNull() | has_any(line, ("-", "‐", "‑")), F.regexp_extract(line, HYPHEN_END, 1)).otherwise("")
    lower = following.rlike(r"^\p{Ll}")
    shouted = (F.upper(following) == following) & following.rlike(r"\p{Lu}")
    conjunction = F.lower(F.regexp_replace(F.substring_index(following, " ", 1), "[.,;:]+$", "")).isin(*CONJUNCTIONS)
    prose = (
        (F.length(line) >= 55) & ends_mid_sentence(line, following) & ~is_heading_start(line) & ~is_heading_start(following)
        & ~is_field_label(following) & ~shouted & ((F.length(following) >= 55) | following.rlike("[.!?;]$"))
    )
    return (
        F.when(is_table_like(line) | is_table_like(following) | ~letter, JOIN_NONE)
        .when((hyphenated != "") & (following.rlike(r"^\p{Lu}") | (F.upper(hyphenated) == hyphenated)), JOIN_HYPHEN)
        .when((hyphenated != "") & conjunction, JOIN_SPACE)
        .when(hyphenated != "", JOIN_WORD)
        .when(line.rlike("[.:;!?]$") | is_list_marker(following), JOIN_NONE)
        .when(lower, in_lower)
        .when(prose, JOIN_SPACE)
        .otherwise(JOIN_NONE)
    )


def version_number(name: Column) -> Column:
    """v12 -> 12, anything else null."""
    return F.try_to_number(F.regexp_extract(name, "^v([1-9][0-9]*)$", 1), F.lit("999999999")).cast("int")


def is_subdir(name: Column) -> Column:
    """P25."""
    return name.rlike("^[a-z0-9_]+(/[a-z0-9_]+)?$")


def budget_of(window: int, overhead_chars: int, output_tokens: int = OUTPUT_TOKENS) -> int:
    """N15 for one profile, on the driver."""
    room = window * WINDOW_RATIO - (math.floor(overhead_chars / CHARS_PER_TOKEN) + 1) - output_tokens
    return max(LEAST_BUDGET, math.floor(room * CHARS_PER_TOKEN))
