"""String functions shared by the operators: entity decoding, whitespace, Markdown escaping, sizes."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
#
# Markdown escapes, applied to each text node in this order (pattern, replacement); "^" is the start of the node.
MD_ESCAPES = [
    (r"\\", r"\\\\"),
    (r"\*", r"\\*"),
    (r"^-", r"\\-"),
    (r"^\+ ", r"\\+ "),
    (r"^(=+)", r"\\$1"),
    (r"^(#{1,6}) ", r"\\$1 "),
    (r"`", r"\\`"),
    (r"^~~~", r"\\~~~"),
    (r"\[", r"\\["),
    (r"\]", r"\\]"),
    (r"^>", r"\\>"),
    (r"_", r"\\_"),
    (r"^(\d+)\. ", r"$1\\. "),
]
# Byte units for human sizes, one decimal, base 1024.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]
# Largest payload accepted, in characters.
MAX_PAYLOAD_CHARS = 1_000_000
# Inline base64 image marker.
BASE64_IMAGE = r"(data:image/[^;]+;base64,)[a-zA-Z0-9+/=]+"
BASE64_REPLACEMENT = "$1[IMAGE_BINARY]"
# ---------------------------------------------------------------------------------------------------------------

# Named character references of HTML 4 (and ``apos``), from the standard library's table.
ENTITIES = {name: chr(code) for name, code in sorted(html.entities.name2codepoint.items())} | {"apos": "'"}
# What stands behind an ampersand: a decimal, a hexadecimal or a named reference.
DECIMAL, HEXADECIMAL, NAMED = "^#([0-9]{1,7});", "^#[xX]([0-9a-fA-F]{1,6});", "^([A-Za-z0-9]+);"
LAST_CODE_POINT = 0x10FFFF

# Private-use code points that the Markdown renderer uses as in-band marks (it escapes those of the input).
MARKER_CLASS = "[\ue000-\ue00f]"

# JavaScript ``\s`` (used by ``trim``): ASCII whitespace plus NBSP, BOM and the Unicode spaces.
JS_SPACE = "[\\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

NOT_JS_SPACE = "[^" + JS_SPACE[1:]

# The non-ASCII members of JS_SPACE, mapped to ' ' by ``translate`` (a char map, far cheaper than a Unicode
# regex class) before an ASCII ``\s`` regex does the rest.
JS_EXTRA_SPACES = "\u00a0\ufeff\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def js_spaces_to_ascii(c: Column) -> Column:
    return F.translate(c, JS_EXTRA_SPACES, " " * len(JS_EXTRA_SPACES))


def decode_entities(c: Column) -> Column:
    """Character references, each decoded once (so ``&amp;lt;`` stays ``&lt;``). A number that is no character becomes
    U+FFFD; what is no reference stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def number(n: Column) -> Column:
        valid = (n > 0) & (n <= LAST_CODE_POINT) & ~n.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))

    def part(p: Column) -> Column:
        rest = F.regexp_replace(p, "^[^;]*;", "")
        named = F.try_element_at(names, F.regexp_extract(p, NAMED, 1))
        return (F.when(p.rlike(DECIMAL), F.concat(number(F.regexp_extract(p, DECIMAL, 1).cast("bigint")), rest))
                 .when(p.rlike(HEXADECIMAL), F.concat(number(F.conv(F.regexp_extract(p, HEXADECIMAL, 1), 16, 10).cast("bigint")), rest))
                 .when(named.isNotNull(), F.concat(named, rest))
                 .otherwise(F.concat(F.lit("&"), p)))

    parts = F.split(c, "&")
    decoded = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(part(p)))
    return F.when(F.instr(c, "&") > 0, F.array_join(decoded, "")).otherwise(c)


def collapse_ws(c: Column) -> Column:
    """Runs of HTML whitespace become one space (NBSP is content and survives)."""
    return F.regexp_replace(c, "[ \\t\\r\\n\\f]+", " ")


# The unanchored escapes (backslash, *, `, [, ], _) only ever insert a backslash before one character, and only
# the first of them touches a backslash, so applying them in one pass equals applying them in table order. The
# anchored ones (start of the text node) then run only when the node starts with one of their characters.
_UNANCHORED = r"([\\*`\[\]_])"
_ANCHORED = [(p, r) for p, r in MD_ESCAPES if p.startswith("^")]
_ANCHORED_START = r"^([-+=#~>]|\d+\. )"


def md_escape(c: Column) -> Column:
    """The thirteen Markdown escapes, same result as applying the table in order."""
    c = F.regexp_replace(c, _UNANCHORED, r"\\$1")
    anchored = c
    for pat, rep in _ANCHORED:
        anchored = F.regexp_replace(anchored, pat, rep)
    return F.when(c.rlike(_ANCHORED_START), anchored).otherwise(c)


def md_escape_table(c: Column) -> Column:
    """K11 applied literally, rule by rule (reference form; used by tests to check :func:`md_escape`)."""
    for pat, rep in MD_ESCAPES:
        c = F.regexp_replace(c, pat, rep)
    return c


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(js_trim(c) == "", F.lit(True))


def utf8_bytes(c: Column) -> Column:
    """Byte size of the UTF-8 encoding (what a clipboard entry weighs)."""
    return F.octet_length(c)


def format_bytes(c: Column) -> Column:
    """Human size: ``0 B`` for 0 or null, else one decimal in B..TB with a trailing ``.0`` dropped."""
    b = c.cast("double")
    i = F.least(F.floor(F.log(1024.0, b)), F.lit(4)).cast("int")
    v = F.round(b / F.pow(F.lit(1024.0), i), 1)
    txt = F.regexp_replace(F.format_string("%.1f", v), "\\.0$", "")
    unit = F.element_at(F.array(*[F.lit(u) for u in BYTE_UNITS]), i + 1)
    return F.when(b.isNull() | (b <= 0), F.lit("0 B")).otherwise(F.concat(txt, F.lit(" "), unit))


def redact_base64(c: Column) -> Column:
    return F.regexp_replace(c, BASE64_IMAGE, BASE64_REPLACEMENT)


def normalize_text(c: Column) -> Column:
    """Line ends CRLF→LF and trailing whitespace dropped, for comparing plain entries."""
    return F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\\s+$", "")
