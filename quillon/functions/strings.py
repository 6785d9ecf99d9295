"""String, binary and XML functions.

Arguments are Columns; integers, strings and other constants are taken as literals.  Unless a docstring says otherwise
a null argument gives null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def text(x) -> Column:
    return col(x).cast("string")


def guarded(result: Column, *args: Column) -> Column:
    """result, or null where an argument is null."""
    known = F.lit(True)
    for a in args:
        known = known & a.isNotNull()
    return F.when(known, result)


def ascii_code(s) -> Column:
    """The first UTF-16 unit's code; null for the empty string."""
    first = F.substring(text(s), 1, 1)
    unit = F.conv(F.hex(F.substring(F.encode(first, "UTF-16BE"), 1, 2)), 16, 10).cast("int")
    return F.when(F.length(text(s)) > 0, unit)


def bit_length(s) -> Column:
    """Sixteen bits a character."""
    return F.length(text(s)).cast("long") * 16


def octet_length(s) -> Column:
    """Two bytes a character."""
    return F.length(text(s)).cast("long") * 2


def char(n) -> Column:
    """The character of a UTF-16 code."""
    return F.decode(F.unhex(F.lpad(F.hex(col(n).cast("long")), 4, "0")), "UTF-16BE")


def char_length(s) -> Column:
    return F.char_length(col(s))


def length(s) -> Column:
    return F.length(col(s)).cast("long")


def concat(*parts) -> Column:
    """Joins the arguments that are not null; null when all are."""
    cols = [text(p) for p in parts]
    return F.when(F.coalesce(*cols).isNotNull(), F.concat(*[F.coalesce(c, F.lit("")) for c in cols]))


def concat_ws(sep, *parts) -> Column:
    """Joins the non-null, non-empty arguments; the empty string when there are none."""
    return F.concat_ws("", *_between(F.coalesce(text(sep), F.lit("")), [text(p) for p in parts]))


def _between(sep: Column, parts: list[Column]) -> list[Column]:
    """Each part that is neither null nor empty, with the separator before it if such a part stands to its left."""
    out, before = [], F.lit(False)
    for p in parts:
        there = F.coalesce(p != "", F.lit(False))
        out.append(F.when(there, F.concat(F.when(before, sep).otherwise(F.lit("")), p)))
        before = before | there
    return out


def soundex(s) -> Column:
    """American Soundex of the letters: the first as typed, 0000 without letters."""
    letters = F.regexp_replace(text(s), "[^A-Za-z]", "")
    code = F.concat(F.substring(letters, 1, 1), F.substring(F.soundex(letters), 2, 3))
    return F.when(F.length(letters) > 0, code).otherwise(F.when(text(s).isNotNull(), "0000"))


def difference(a, b) -> Column:
    """How many of the four Soundex places agree."""
    x, y = soundex(a), soundex(b)
    return sum((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5))


def hextoraw(s) -> Column:
    """Four hexadecimal digits a character."""
    return F.decode(F.unhex(text(s)), "UTF-16BE")


def rawtohex(s) -> Column:
    return F.lower(F.hex(F.encode(text(s), "UTF-16BE")))


def insert(s, start, n, new) -> Column:
    """Replace n characters from a place counted from 1.

    A null text gives the new text and a null new text the text; the text stays when the place or n lies outside it.
    """
    a, i, k, b = text(s), col(start).cast("int"), col(n).cast("int"), text(new)
    fits = (i >= 1) & (k > 0) & (i <= F.length(a) + 1) & (F.length(b) > 0)
    spliced = F.concat(F.substr(a, F.lit(1), i - 1), b, F.substr(a, i + k))
    return F.when(a.isNull(), b).when(b.isNull() | i.isNull() | k.isNull(), a).when(fits, spliced).otherwise(a)


def left(s, n) -> Column:
    return guarded(F.substr(text(s), F.lit(1), F.greatest(col(n).cast("int"), F.lit(0))), text(s), col(n))


def right(s, n) -> Column:
    k = F.greatest(col(n).cast("int"), F.lit(0))
    return guarded(F.when(k >= F.length(text(s)), text(s)).otherwise(F.substr(text(s), F.length(text(s)) - k + 1, k)), text(s), col(n))


def locate(search, s, start=1) -> Column:
    """The place of a text from a start on, counted from 1; a negative start searches backwards from that far before the end; 0: none."""
    a, b, i = text(search), text(s), col(start).cast("int")
    ahead = F.call_function("locate", a, b, F.greatest(i, F.lit(1)))
    # The last occurrence that starts at or before a place is the first of the reversed text from its mirror on.
    last = F.length(b) + i + 1
    mirrored = F.call_function("locate", F.reverse(a), F.reverse(b), F.greatest(F.length(b) - (last + F.length(a) - 1) + 1, F.lit(1)))
    back = F.when((last >= 1) & (mirrored > 0), F.length(b) - mirrored - F.length(a) + 2).otherwise(0)
    return guarded(F.when(i < 0, back).otherwise(ahead), a, b, i)


def instr(s, search, start=1) -> Column:
    return locate(search, s, start)


def position(search, s) -> Column:
    return locate(search, s, 1)


def ltrim(s, ch=" ") -> Column:
    return F.ltrim(text(s), text(ch))


def rtrim(s, ch=" ") -> Column:
    return F.rtrim(text(s), text(ch))


def trim(s, ch=" ") -> Column:
    return F.trim(text(s), text(ch))


def repeat(s, n) -> Column:
    return F.repeat(text(s), F.greatest(col(n).cast("int"), F.lit(0)))


def replace(s, old, new="") -> Column:
    """Nothing replaces an empty text; without a new text the old one goes."""
    return F.replace(text(s), text(old), text(new))


def space(n) -> Column:
    return F.repeat(F.lit(" "), F.greatest(col(n).cast("int"), F.lit(0)))


def substr(s, start, n=None) -> Column:
    """Counted from 1; a negative start counts from the end and stays in the text."""
    a, i = text(s), col(start).cast("int")
    first = F.when(i < 0, F.greatest(F.length(a) + i + 1, F.lit(1))).otherwise(F.greatest(i, F.lit(1)))
    return F.substr(a, first) if n is None else F.substr(a, first, F.greatest(col(n).cast("int"), F.lit(0)))


def lpad(s, n, pad=" ") -> Column:
    return F.lpad(text(s), n, pad)


def rpad(s, n, pad=" ") -> Column:
    return F.rpad(text(s), n, pad)


def regexp_replace(s, pattern, new) -> Column:
    return F.regexp_replace(text(s), text(pattern), text(new))


_ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"'}


def stringencode(s) -> Column:
    """Escape a text as in a Java source: named escapes, and \\uXXXX for characters outside printable ASCII."""

    @F.pandas_udf("string")
    def encode(v: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            out = []
            for c in t:
                if c in _ESCAPES:
                    out.append(_ESCAPES[c])
                elif " " <= c <= "~":
                    out.append(c)
                else:
                    raw = c.encode("utf-16-be").hex()
                    out += [f"\\u{raw[i : i + 4]}" for i in range(0, len(raw), 4)]
            return "".join(out)

        return v.map(one)

    return encode(text(s))


def stringdecode(s) -> Column:
    """Undo stringencode; octal escapes are read too."""

    @F.pandas_udf("string")
    def decode(v: pd.Series) -> pd.Series:
        import re

        named = {"t": "\t", "n": "\n", "f": "\f", "r": "\r", "b": "\b"}

        def put(m):
            x = m[1]
            if x[0] == "u":
                return chr(int(x[1:], 16))
            return chr(int(x, 8)) if x.isdigit() else named.get(x, x)

        def one(t):
            if t is None:
                return None
            raw = re.sub(r"\\(u[0-9a-fA-F]{4}|[0-3][0-7]{2}|.)", put, t, flags=re.S)
            return raw.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")

        return v.map(one)

    return decode(text(s))


def stringtoutf8(s) -> Column:
    return F.encode(text(s), "UTF-8")


def utf8tostring(b) -> Column:
    return F.decode(col(b), "UTF-8")


def xmltext(s, escape_newlines=False) -> Column:
    """Escape a text for XML: named entities, and numbers for characters outside printable ASCII; line ends only if asked."""
    out = text(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    if escape_newlines:
        out = F.replace(F.replace(out, F.lit("\n"), F.lit("&#xa;")), F.lit("\r"), F.lit("&#xd;"))
    wide = F.split(out, "")
    number = lambda c: F.concat(F.lit("&#x"), F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0+", "")), F.lit(";"))
    return F.when(out.rlike("[^\\x00-\\x7f]"), F.array_join(F.transform(wide, lambda c: F.when(c.rlike("[^\\x00-\\x7f]"), number(c)).otherwise(c)), "")).otherwise(out)


def xmlattr(name, value) -> Column:
    return F.concat(F.lit(" "), text(name), F.lit('="'), xmltext(value), F.lit('"'))


def xmlnode(name, attributes=None, content=None, indent=True) -> Column:
    """An element; content with a line end is set on lines of its own, indented by four blanks if asked."""
    start = F.concat(F.lit("<"), text(name), F.coalesce(text(attributes), F.lit("")) if attributes is not None else F.lit(""))
    if content is None:
        return F.concat(start, F.lit("/>\n"))
    body = text(content)
    if indent:
        lined = F.concat(F.lit("\n"), F.regexp_replace(body, "(?m)^", "    "), F.when(body.endswith("\n"), "").otherwise("\n"))
        lined = F.regexp_replace(lined, "\n    \n?$", "\n")
        shown = F.when(body.contains("\n"), lined).otherwise(body)
    else:
        shown = body
    full = F.concat(start, F.lit(">"), shown, F.lit("</"), text(name), F.lit(">\n"))
    return F.when(body.isNull(), F.concat(start, F.lit("/>\n"))).otherwise(full)


def xmlcomment(s) -> Column:
    """A comment; doubled hyphens in it are parted."""
    inner = F.replace(F.replace(text(s), F.lit("--"), F.lit("- -")), F.lit("--"), F.lit("- -"))
    return F.concat(F.lit("<!-- "), inner, F.lit(" -->\n"))


def xmlcdata(s) -> Column:
    """A CDATA section, or escaped text where its end mark occurs."""
    return F.when(text(s).contains("]]>"), xmltext(s)).otherwise(F.concat(F.lit("<![CDATA["), text(s), F.lit("]]>")))


def xmlstartdoc() -> Column:
    return F.lit('<?xml version="1.0"?>\n')


def lower(s) -> Column:
    return F.lower(text(s))


def upper(s) -> Column:
    return F.upper(text(s))


FUNCTIONS = {
    "ASCII": ascii_code, "BIT_LENGTH": bit_length, "CHAR": char, "CHR": char, "CHAR_LENGTH": char_length, "CHARACTER_LENGTH": char_length, "CONCAT": concat, "CONCAT_WS": concat_ws,
    "DIFFERENCE": difference, "HEXTORAW": hextoraw, "INSERT": insert, "LCASE": lower, "LEFT": left, "LENGTH": length, "LOCATE": locate, "CHARINDEX": locate, "INSTR": instr, "LTRIM": ltrim,
    "OCTET_LENGTH": octet_length, "RAWTOHEX": rawtohex, "REPEAT": repeat, "REPLACE": replace, "RIGHT": right, "RTRIM": rtrim, "SOUNDEX": soundex, "SPACE": space, "SUBSTR": substr,
    "SUBSTRING": substr, "UCASE": upper, "LOWER": lower, "UPPER": upper, "POSITION": position, "TRIM": trim, "STRINGENCODE": stringencode, "STRINGDECODE": stringdecode,
    "STRINGTOUTF8": stringtoutf8, "UTF8TOSTRING": utf8tostring, "XMLATTR": xmlattr, "XMLNODE": xmlnode, "XMLCOMMENT": xmlcomment, "XMLCDATA": xmlcdata, "XMLSTARTDOC": xmlstartdoc,
    "XMLTEXT": xmltext, "REGEXP_REPLACE": regexp_replace, "RPAD": rpad, "LPAD": lpad,
}
