"""Masks: kinds of values in texts, each written from the grammar of its kind.

normalized() puts <kind> for them. Kinds are taken one after another, in the order asked for; what one has taken is safe
from those after it. Everything runs in the JVM; kinds that need arithmetic (card numbers) are checked by expressions
over their digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import _c

_HEX, _ALNUM, _DIGIT = "[0-9A-Fa-f]", "[0-9A-Za-z]", "[0-9]"
#: 0 to 255 without leading zeros.
_OCTET = "(?:" + "|".join(["25[0-5]", "2[0-4][0-9]", "1[0-9][0-9]", "[1-9][0-9]", "[0-9]"]) + ")"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
#: 0 to 65535 without leading zeros.
_PORT = "(?:" + "|".join(["6553[0-5]", "655[0-2][0-9]", "65[0-4][0-9]{2}", "6[0-4][0-9]{3}", "[1-5][0-9]{4}", "[1-9][0-9]{0,3}", "0"]) + ")"


def _ipv6() -> str:
    """Eight groups; or fewer around one '::', which stands for the ones left out; with an IPv4 tail; or a zone."""
    group = f"{_HEX}{{1,4}}"
    full = rf"\b(?:{group}:){{7}}{group}\b"
    squeezed = "|".join(f"(?:{group}:){{1,{n}}}(?::{group}){{1,{7 - n}}}" for n in range(1, 7))
    zoned = f"fe80:(?::{_HEX}{{0,4}}){{0,4}}%{_ALNUM}+"
    mapped = rf"::(?:ffff:)?{_IPV4}"
    return f"(?i)(?:{full}|{squeezed}|{zoned}|{mapped})"


def _host() -> str:
    """Three labels or more in lower case. A label is letters, digits and inner hyphens, 63 at most, and begins with a letter; a last one may begin with a digit and has 9 at most."""
    label = "[a-z](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return rf"\b(?:{label}\.){{2,}}[a-z0-9](?:[a-z0-9-]{{0,7}}[a-z0-9])?\b"


def _url() -> str:
    """scheme://, then the authority (user, host, port) and path, query and fragment as far as they go, to the last word character."""
    scheme, user = "[a-z][a-z0-9+.-]*", r"[^\s:@]+(?::[^\s:@]*)?@"
    return rf"\b{scheme}://(?:{user})?[^\s:/?#]+(?::{_DIGIT}+)?(?:/[^\s?#]*)?(?:\?[^\s#]*)?(?:#\S*)?\b"


def _duration() -> str:
    amount = rf"{_DIGIT}+(?:\.{_DIGIT}+)?"
    short, long = "us ms s m h d".split(), "microsecond millisecond second minute hour day week month year".split()
    joined = [rf"{_DIGIT}+h{_DIGIT}+m(?:{_DIGIT}+s)?", rf"{_DIGIT}+h{_DIGIT}+s", rf"{_DIGIT}+m{_DIGIT}+s"]
    return rf"\b(?:{'|'.join(joined)}|{amount}(?:{'|'.join(short)})|{amount}\s*(?:{'|'.join(long)})s?)\b"


def _bytes(n: int, sep: str = "") -> str:
    """n bytes in hexadecimal."""
    return rf"\b(?:{_HEX}{{2}}{sep}){{{n - 1}}}{_HEX}{{2}}\b"


_GAP = r"[-.\s]?"
#: Kind -> pattern. The names and their order are fixed values; the patterns are composed here.
PATTERNS = {
    "ipv4_port": rf"\b{_IPV4}:{_PORT}\b",
    "ipv4": rf"\b{_IPV4}\b",
    "ipv6": _ipv6(),
    "email": rf"\b[\w.%+-]+@(?:[0-9A-Za-z.-]+)\.[A-Za-z]{{2,}}\b",
    "url": _url(),
    "fqdn": _host(),
    "uuid": rf"\b{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}\b",
    "mac": rf"{_bytes(6, '[:-]')}|\b(?:{_HEX}{{4}}\.){{2}}{_HEX}{{4}}\b",
    "md5": _bytes(16),
    "sha1": _bytes(20),
    "sha256": _bytes(32),
    # a slash that no word character precedes, then components; or slashes alone, two or more
    "path": r"(?<!\w)(?:/(?:/*+[\w.-]++)++/*+|//++)",
    "oauth": r"\bya29\.[\w-]*\w\b",
    # a name, dotted perhaps, and what stands in parentheses right after it
    "function": r"\b\w+(?:\.+\w+)*+\.*+\([^)]*\)",
    "hexcolor": rf"#(?:{_HEX}{{2}}){{3}}\b",
    "version": rf"\b[Vv]{_DIGIT}+\.{_DIGIT}+(?:\.{_DIGIT}+)?(?:-{_ALNUM}+)?\b",
    "hexnum": rf"\b0x{_HEX}+\b",
    "duration": _duration(),
    "num": rf"[-+]?{_DIGIT}+(?:\.{_DIGIT}+)?(?:[Ee][-+]?{_DIGIT}+)?",
    "credit_card": rf"\b{_DIGIT}(?:[- ]?{_DIGIT}){{12,18}}\b",
    # an area of 001 to 899 but not 666, a group and a serial number that aren't all zeros
    "ssn": rf"\b(?!000|666|9)({_DIGIT}{{3}})-(?!00)({_DIGIT}{{2}})-(?!0000)({_DIGIT}{{4}})\b",
    "phone": "",
}
#: The kinds that are masked unless others are asked for.
DEFAULT = ["ipv4_port", "ipv4", "ipv6", "email", "url", "fqdn", "uuid", "mac", "md5", "sha1", "sha256", "path", "oauth", "function", "hexcolor", "version"]


#: A text without this has no value of the kind, so the pattern needn't run.
NEEDLES = {"ipv4_port": ".", "ipv4": ".", "ipv6": ":", "email": "@", "url": "://", "fqdn": ".", "uuid": "-", "path": "/", "oauth": "ya29.", "function": "(", "hexcolor": "#", "version": ".", "hexnum": "0x", "ssn": "-"}


def _replaced(col: Column, pattern: str, mark: str, needle: str | None) -> Column:
    if needle is None:
        return F.regexp_replace(col, pattern, mark)
    own = lambda x: F.when(F.contains(x, F.lit(needle)), F.regexp_replace(x, pattern, mark)).otherwise(x)
    return F.get(F.transform(F.array(col), own), F.lit(0))  # the text so far is worked out once


def _phones() -> list[str]:
    """International forms, then national ones with an area in parentheses or apart."""
    three, four = f"{_DIGIT}{{3}}", f"{_DIGIT}{{4}}"
    country = rf"\+{_DIGIT}{{1,3}}{_GAP}\(?{_DIGIT}{{1,4}}\)?{_GAP}{_DIGIT}{{1,4}}{_GAP}{_DIGIT}{{1,9}}"
    return [country, rf"\({three}\){_GAP}{three}{_GAP}{four}", rf"\b{three}[-.\s]{three}[-.\s]{four}\b"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _is_card(x: Column) -> Column:
    """13 to 19 digits, not all zeros, whose Luhn sum is a multiple of ten."""
    d = F.transform(F.split(F.reverse(_digits(x)), ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(d, lambda c, i: F.when(i % 2 == 0, c).when(c > 4, 2 * c - 9).otherwise(2 * c)), F.lit(0), lambda a, c: a + c)
    return (F.length(_digits(x)).between(13, 19)) & ~_digits(x).rlike("^0+$") & (total % 10 == 0)


def _is_phone(x: Column) -> Column:
    """By the North American plan for ten digits, or eleven after 1: area and exchange begin with 2 to 9. Others need seven digits."""
    d = _digits(x)
    national = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).when(F.length(d) == 10, d)
    return F.when(national.isNotNull(), national.rlike("^[2-9][0-9]{2}[2-9]")).otherwise(F.length(d) >= 7)


def _checked(col: Column, pattern: str, ok, mark: str) -> Column:
    """col with mark for each match of pattern that passes ok."""
    found = F.regexp_extract_all(col, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(col, pattern, -1)
    shown = F.transform(found, lambda m: F.when(ok(m), F.lit(mark)).otherwise(m))
    joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(found)), shown, lambda g, m: F.concat(g, m)), ""), F.element_at(gaps, -1))
    return F.when(F.size(found) > 0, joined).otherwise(col)


def normalized(s, patterns: list[str] | str | None = None, own: dict[str, str] | None = None) -> Column:
    """The text with <kind> for each value of the kinds, a list or names with commas between; unknown names do nothing.

    own: patterns that stand for those of the same name, or for further kinds.
    """
    names = DEFAULT if patterns is None else [p.strip() for p in patterns.split(",")] if isinstance(patterns, str) else patterns
    col, used, table = _c(s), [], PATTERNS | (own or {})
    for i, name in enumerate(names):
        if name not in table:
            continue
        mark = chr(0xE000 + i)  # private characters, so that no later kind sees the words of an earlier mask
        used.append((mark, name))
        if name == "credit_card":
            col = _checked(col, table[name], _is_card, mark)
        elif name == "phone":
            for form in _phones():
                col = _checked(col, form, _is_phone, mark)
        else:
            col = _replaced(col, table[name], mark, NEEDLES.get(name))
    for mark, name in used:
        col = F.replace(col, F.lit(mark), F.lit(f"<{name}>"))
    return col


def normalized_fields(df, patterns: list[str] | str | None = None):
    """df with every text in it masked: string columns, and texts inside structs, arrays and maps (values)."""
    from pyspark.sql import types as T

    def one(x: Column, kind) -> Column:
        if isinstance(kind, T.StringType):
            return normalized(x, patterns)
        if isinstance(kind, T.StructType):
            return F.when(x.isNotNull(), F.struct(*[one(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(x, lambda v: one(v, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(x, lambda _, v: one(v, kind.valueType))
        return x

    return df.select(*[one(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
