"""Text expressions: HTML cleaning, domains, topic gates, dates, bullets."""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, functions as F

from millrace.functions import vocabulary as v

# Letters, digits and underscore in any script; both Java and RE2 read it so.
WORD_CHAR = r"[\p{L}\p{N}_]"
NOT_WORD_CHAR = r"[^\p{L}\p{N}_]"
SPACES = r"[\s\x{00a0}\x{0085}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


# A character reference: numeric, or a name of up to 32 characters, with or without its semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
CLOSED_REFERENCE = REFERENCE.replace(";?", ";")
# Names that count without a semicolon, longest first, so that the longest one that begins a reference is found.
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_REPLACEMENT = "\ufffd"
# The standard library's table of names, dealt into buckets by their CRC: a literal map is searched from its front,
# an array is not. Read from one JSON literal, which Spark folds into a constant.
_BUCKETS = 4096
_NAMES = [{} for _ in range(_BUCKETS)]
for _name, _text in html5.items():
    _NAMES[zlib.crc32(_name.encode()) % _BUCKETS][_name] = _text
_NAMES_JSON = json.dumps(_NAMES)


def _named(name: Column) -> Column:
    """The text of a reference's name, null for an unknown one."""
    buckets = F.from_json(F.lit(_NAMES_JSON), "array<map<string,string>>")
    return F.try_element_at(F.get(buckets, (F.crc32(name.cast("binary")) % _BUCKETS).cast("int")), name)


def unescape(column: Column, closed: bool = False) -> Column:
    """Resolve character references in one pass: what comes out of one is never read as another.
    With ``closed`` only those that end in a semicolon count."""
    pattern = CLOSED_REFERENCE if closed else REFERENCE
    references = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    resolved = F.zip_with(F.split(column, pattern, -1), references, lambda gap, r: F.concat(gap, F.when(r.isNull(), "").otherwise(_resolve(r, closed))))
    return F.when(F.contains(column, F.lit("&")), F.array_join(resolved, "")).otherwise(column)


def _resolve(reference: Column, closed: bool) -> Column:
    body = F.substring(reference, 2, 1 << 30)
    opening = F.regexp_extract(body, f"^(?:{_OPEN_NAMES})", 0)
    begun = F.when(opening != "", F.concat(_named(opening), F.substring(body, F.length(opening) + 1, F.lit(1 << 30))))
    named = F.coalesce(_named(body), *([] if closed else [begun]), reference)
    hexed = F.regexp_extract(body, "^#[xX]0*([0-9a-fA-F]*)", 1)
    digits = F.regexp_extract(body, "^#0*([0-9]*)", 1)
    # Nothing beyond seven digits is a character.
    number = F.when(body.rlike("^#[xX]"), F.when(F.length(hexed) <= 6, F.conv(hexed, 16, 10).cast("long"))).otherwise(
        F.when(F.length(digits) <= 7, F.coalesce(digits.try_cast("long"), F.lit(0))))
    number = F.when(body.rlike("^#[xX]0*;?$"), F.lit(0)).otherwise(number)
    return F.when(~body.rlike("^#[0-9xX]"), named).otherwise(_numbered(number))


def _numbered(code: Column) -> Column:
    """The character of a code, with the repairs that the markup standard names: code page 1252 for the
    upper controls, the replacement character for what no text can hold, nothing for other non-characters."""
    legacy = F.create_map(*[F.lit(x) for n in range(0x80, 0xA0) for x in (n, bytes([n]).decode("cp1252", "ignore") or chr(n))])
    gone = (
        code.between(1, 8) | code.isin(0xB, 0x7F) | code.between(0xE, 0x1F)
        | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
    )
    return (
        F.when(code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit(_REPLACEMENT))
        .when(code.between(0x80, 0x9F), F.try_element_at(legacy, code.cast("int")))
        .when(gone, F.lit(""))
        .otherwise(_character(F.hex(code)))
    )


def _character(hex_code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex_code, 8, "0")), "UTF-32")


def clean_html(column: Column, max_chars: int | None = None, closed: bool = False) -> Column:
    """Tags to spaces, references resolved (``closed``: only those with a semicolon), white space squeezed, trimmed."""
    text = unescape(F.regexp_replace(F.coalesce(column, F.lit("")), r"<[^>]+>", " "), closed)
    text = F.trim(F.regexp_replace(text, SPACES, " "))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def stripped(column: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(F.regexp_replace(column, f"^{SPACES}", ""), f"{SPACES}$", "")


def domain_of(url: Column) -> Column:
    """Lower-case host of a URL without a leading ``www.``; empty if none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def word_pattern(terms: Sequence[str]) -> str:
    r"""One pattern for whole-word hits of any term, with ``\w`` in any script."""
    body = "|".join(term.replace(r"\w", WORD_CHAR) for term in terms)
    return f"(^|{NOT_WORD_CHAR})(?:{body})($|{NOT_WORD_CHAR})"


def matches_any(text: Column, terms: Sequence[str]) -> Column:
    return text.rlike("(?iu)" + word_pattern(terms))


def topic_of(text: Column, first: Sequence[str] = v.AI_TERMS, second: Sequence[str] = v.SCIENCE_TERMS) -> Column:
    """``ai``, else ``stem_science``, else ``off_topic``."""
    return F.when(matches_any(text, first), "ai").when(matches_any(text, second), "stem_science").otherwise("off_topic")


def trust_rank(domain: Column, tiers: Sequence[Sequence[str]] = v.TRUST_TIERS) -> Column:
    """0 for the most trusted tier; subdomains count, unknown domains come last."""
    chain = F
    for rank, tier in enumerate(tiers):
        exact = domain.isin(list(tier))
        below = domain.rlike("\\.(" + "|".join(name.replace(".", "\\.") for name in tier) + ")$")
        chain = chain.when(exact | below, rank)
    return chain.otherwise(len(tiers))


def published_at(published: Column, updated: Column) -> Column:
    """The first date that parses; null if neither does."""
    return F.coalesce(F.try_to_timestamp(published), F.try_to_timestamp(updated))


def mail_date(column: Column) -> Column:
    """A date such as ``Tue, 02 Jan 2024 10:00:00 GMT``."""
    return F.try_to_timestamp(F.regexp_replace(column, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))


def date_or_default(column: Column, default: str) -> Column:
    """A blank or missing date reads as the default."""
    return F.coalesce(F.try_to_date(F.nullif(stripped(column), F.lit(""))), F.lit(default).cast("date"))


def without_bullet(line: Column) -> Column:
    """A line without its list marker or number."""
    text = stripped(F.regexp_replace(stripped(line), "^`+", ""))
    text = stripped(F.regexp_replace(text, r"^[-*•–—] ", ""))
    return stripped(F.regexp_replace(text, r"^[0-9][.)](.+)$", "$1"))


def bullets(text: Column) -> Column:
    """The non-empty lines of a text, without markers."""
    return F.filter(F.transform(F.split(text, "\n"), without_bullet), lambda x: x != "")


def polarity_label(polarity: Column) -> Column:
    return F.when(polarity > 0, "Positive").when(polarity < 0, "Negative").otherwise("Neutral")


def with_thousands(number: Column, decimals: int = 0, mark: str = ",") -> Column:
    """A number as text, rounded half up, its thousands set apart by ``mark``."""
    text = F.format_number(F.round(number.cast("decimal(38,18)"), decimals), decimals)
    return text if mark == "," else F.replace(text, F.lit(","), F.lit(mark))
