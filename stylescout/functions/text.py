"""Text functions over columns: token cleaning, pasted input, styles, lines, words. All are built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stylescout.functions.scanner import BLANKS

#: White space as JavaScript sees it (fixed values).
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Helper functions whose arguments are class lists (fixed values).
HELPERS = "cn|clsx|class[nN]ames|twMerge|cx"
#: CSS properties that begin a bare style declaration (fixed values).
STYLE_PROPERTIES = (
    "width|height|min-width|min-height|max-width|max-height|font-size|font-weight|padding|margin|color|background|display|flex|position|top|bottom|left|right|"
    "border|opacity|z-index|line-height|text-align|align-items|justify-content"
)
CONTEXT_CHARS = 140
_QUOTES = "\"'`"
#: Characters that end a token of a line (fixed values): JavaScript's white space, quotes and punctuation.
DELIMITERS = _QUOTES + "{}()<>=,;" + BLANKS
#: Forms of pasted input and of tokens to clean (fixed values).
HELPER_HEAD = rf"(?i)^(?:{HELPERS})\("
CODE_MARKS = (rf"\b(?:{HELPERS}){WS}*\(", rf"(?:^|{WS})[?:](?:{WS}|\z)|&&")
CLASS_ATTRIBUTE = rf"(?i)\bclass(?:Name)?{WS}*={WS}*\{{?{WS}*[\"']([^\"']*)[\"']"
CLASS_TEMPLATE = rf"(?i)\bclass(?:Name)?{WS}*={WS}*\{{{WS}*`([^`]*)`{WS}*\}}"
QUOTED = "\"[^\"]*\"|'[^']*'|`[^`]*`"
STYLE_ATTRIBUTE = rf"(?i)\bstyle{WS}*={WS}*\{{?{WS}*[\"'`]([^\"'`]*)[\"'`]"
STYLE_BRACES = rf"(?is)\bstyle{WS}*={WS}*\{{\{{{WS}*(.*?){WS}*\}}\}}"
CLASS_CHARACTERS = rf"^(?:[a-zA-Z0-9!\-:\[\]_./]|{WS})+\z"
#: Characters of a line in which its tokens are placed at a time.
PIECE_CHARS = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def clean_token(c: Column) -> Column:
    """Strips a helper call's head, array brackets with a quote, and quotes and punctuation at both ends; again while a head remains."""
    head = HELPER_HEAD

    def once(x: Column) -> Column:
        x = F.regexp_replace(x, head, "")
        x = F.regexp_replace(F.regexp_replace(x, rf"^\[([{_QUOTES}])", "$1"), rf"([{_QUOTES}])\]\z", "$1")
        return F.regexp_replace(x, rf"^[{_QUOTES}{{(.]*|[{_QUOTES}}}),;]*\z", "")

    again = lambda x: F.when(x.rlike(head), once(x)).otherwise(x)
    return let(let(let(once(c), again), again), again)


def tokenize(c: Column) -> Column:
    """Cleaned tokens in order, repeats kept; none for null."""
    parts = F.split(F.coalesce(c, F.lit("")), f"{WS}+")
    return F.filter(F.transform(parts, clean_token), lambda x: x != "")


def looks_like_code(c: Column) -> Column:
    return c.rlike(CODE_MARKS[0]) | c.rlike(CODE_MARKS[1])


def extract_paste(c: Column) -> Column:
    """What a pasted text says of classes: an attribute's value, a template's, the quoted pieces of code, or the text itself."""
    t = js_trim(c)
    quoted = F.regexp_extract_all(t, F.lit(QUOTED), F.lit(0))
    inner = F.array_join(F.transform(quoted, lambda x: x.substr(F.lit(2), F.length(x) - 2)), " ")
    return (
        F.when(t.rlike(CLASS_ATTRIBUTE), F.regexp_extract(t, CLASS_ATTRIBUTE, 1))
        .when(t.rlike(CLASS_TEMPLATE), F.regexp_extract(t, CLASS_TEMPLATE, 1))
        .when(looks_like_code(t) & (F.size(quoted) > 0), inner)
        .otherwise(t)
    )


def parse_class_list(c: Column) -> Column:
    """Distinct tokens of a pasted text, in order."""
    return F.array_distinct(tokenize(extract_paste(c)))


def normalize_style_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "-([a-z])", "$1"))


def normalize_style_value(c: Column) -> Column:
    x = F.lower(F.regexp_replace(js_trim(c), rf"^[{_QUOTES}]|[{_QUOTES}]\z", ""))
    x = let(x, lambda v: F.when(v.endswith(";"), js_trim(F.regexp_replace(v, r";\z", ""))).otherwise(v))
    return F.regexp_replace(x, r"^(\d+)px\z", "$1")


def is_style_input(c: Column) -> Column:
    t = js_trim(c)
    key = js_trim(F.split(t, ":", 2)[0])
    return (
        F.when(t.rlike(rf"(?i)^style{WS}*="), True)
        .when(t.rlike(r"[\"'`?(){}]|&&"), False)
        .when(~t.contains(":"), False)
        .when(t.rlike("[;,]"), True)
        .otherwise(key.rlike(rf"(?i)^(?:{STYLE_PROPERTIES})"))
    )


def parse_style_list(c: Column) -> Column:
    """Distinct ``style:key:value`` tokens of a pasted declaration list, in order."""
    t = js_trim(c)
    body = F.when(t.rlike(STYLE_ATTRIBUTE), F.regexp_extract(t, STYLE_ATTRIBUTE, 1)).when(t.rlike(STYLE_BRACES), F.regexp_extract(t, STYLE_BRACES, 1)).otherwise(t)
    parts = let(body, lambda b: F.when(b.contains(";"), F.split(b, ";")).otherwise(F.split(b, ",")))

    def token(pair: Column) -> Column:
        colon = F.locate(":", pair)
        key = normalize_style_key(F.regexp_replace(js_trim(pair.substr(F.lit(1), colon - 1)), "['\"]", ""))
        value = normalize_style_value(F.regexp_replace(js_trim(pair.substr(colon + 1, F.length(pair))), "['\",]", ""))
        return F.when((colon > 0) & (key != "") & (value != ""), F.concat(F.lit("style:"), key, F.lit(":"), value))

    return F.array_distinct(F.filter(F.transform(F.transform(parts, js_trim), token), lambda x: x.isNotNull()))


def looks_like_class_input(c: Column) -> Column:
    t = js_trim(F.coalesce(c, F.lit("")))
    return (
        F.when(t == "", False)
        .when(t.rlike(rf"(?i)\bclass(?:Name)?{WS}*="), True)
        .when(t.rlike("[{};()=<>]"), False)
        .otherwise(t.rlike(CLASS_CHARACTERS) & t.rlike(WS))
    )


def arbitrary_base(c: Column) -> Column:
    """A class with every bracket's content blanked; null unless it has both brackets."""
    return F.when(c.contains("[") & c.contains("]"), F.regexp_replace(c, r"\[[^\]]*\]", "[]"))


def lines(c: Column) -> Column:
    return F.split(c, "\r?\n", -1)


def line_tokens(c: Column) -> Column:
    """Distinct tokens of a line; colons, brackets, ``!`` and ``/`` stay in them."""
    return F.array_distinct(F.filter(F.split(c, rf"(?:[{_QUOTES}{{}}()<>=,;]|{WS})+"), lambda x: x != ""))


def placed_tokens(line: Column) -> Column:
    """array<struct<column, class>>: the distinct tokens of a line in order, each with the place where it first stands as a token.

    Long lines are taken in pieces that end where a token ends, so that no token is looked for in more than a piece.
    """
    blanks = " " * len(DELIMITERS)
    inner = re.escape(DELIMITERS)

    def placed(piece: Column, start: Column) -> Column:
        def found(padded: Column) -> Column:
            each = F.array_distinct(F.filter(F.split(padded, " "), lambda x: x != ""))
            return F.transform(each, lambda t: F.struct((F.instr(padded, F.concat(F.lit(" "), t, F.lit(" "))) - 1 + start).alias("column"), t.alias("class")))

        return let(F.concat(F.lit(" "), F.translate(piece, DELIMITERS, blanks), F.lit(" ")), found)

    pieces = F.regexp_extract_all(line, F.lit(rf"(?s).{{1,{PIECE_CHARS}}}[^{inner}]*"), F.lit(0))
    starts = lambda p: F.aggregate(p, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    everywhere = let(pieces, lambda p: F.flatten(F.zip_with(p, F.slice(starts(p), F.lit(1), F.size(p)), placed)))
    # a token of several pieces counts where it stands first
    by_token = F.sort_array(F.transform(everywhere, lambda x: F.struct(x["class"], x["column"])))
    firsts = let(by_token, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["class"] != x["class"])))
    in_order = F.sort_array(F.transform(firsts, lambda x: F.struct(x["column"], x["class"])))
    return F.when(F.length(line) <= PIECE_CHARS, placed(line, F.lit(0))).otherwise(in_order)


def query_words(c: Column) -> Column:
    """Distinct lower-case words of two characters or more, punctuation at their ends stripped, in order."""
    ends = rf"^[.,;:!?{_QUOTES}]+|[.,;:!?{_QUOTES}]+\z"
    parts = F.transform(F.split(F.lower(c), rf"(?:[,;]|{WS})+"), lambda x: F.regexp_replace(x, ends, ""))
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= 2))


def context_snippet(line: Column, fallback: Column | None = None) -> Column:
    shown = line if fallback is None else F.coalesce(line, fallback)
    return F.substring(js_trim(shown), 1, CONTEXT_CHARS)


def fold_columns(places: Column) -> Column:
    """One column of several 0-based places, -1 for none: the least, but a 0 counts as not set when a later place is met."""
    return F.aggregate(places, F.lit(0), lambda col, i: F.when((i != -1) & ((col == 0) | (i < col)), i).otherwise(col))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)\z", 1)
