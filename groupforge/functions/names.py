"""Name and text functions as column expressions; `norm_arrow` is the vectorised twin of `norm` on Arrow columns."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that are no part of a name, and abbreviations.
FORMS = ("SASU", "SAS", "SARL", "SNC", "SCI", "SA", "SE", "EURL", "SCA", "GIE", "SEP", "SCS")
ABBREVIATIONS = (("STE", "SOCIETE"), ("CIE", "COMPAGNIE"), ("ETS", "ETABLISSEMENTS"), ("ST", "SAINT"))
#: What may stand before a brand, any number of times.
PREFIXES = (
    "SOCIETE CIVILE IMMOBILIERE", "SOCIETE CIVILE", "STE CIVILE", "SOCIETE", "STE", "SCI", "SCEA", "SCE", "GFA", "GFV", "GAEC", "EARL", "SA", "SAS", "SASU", "SARL", "EURL", "SNC", "SC", "GIE", "SE", "SCA", "SOC",
    "CIE", "COMPAGNIE", "ETS", "ETABLISSEMENTS", "LES", "LE", "LA", "L", "DES", "DU", "DE", "D",
)
#: Funds are no companies.
FUNDS = r"(?i:\b(?:FCP|FCPE|FCPR|FCPI|FCT|FPCI|FPS|FIP|OPC|OPCVM|compartiment)\b|^fonds\b|\bfund$)|\b(?:PARTS?|[Pp]arts?) [A-Z0-9]{1,2}\b"


#: Signs read as an apostrophe, and ligatures that don't decompose.
_APOSTROPHES = "’‘ʼ´`′"
_LIGATURES = {"Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae", "ß": "ss", "ẞ": "SS"}


def _ascii_of() -> dict[str, str]:
    """What stays of each character beyond ASCII: the ASCII part of its compatibility decomposition, if it has one.

    None beyond the first two planes has one.
    """
    found = {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        left = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if left:
            found[chr(code)] = left
    return found | dict.fromkeys(_APOSTROPHES[:4] + _APOSTROPHES[5:], "'") | _LIGATURES


_ASCII = _ascii_of()


def plain(c: Column) -> Column:
    """ASCII without accents: compatibility decomposition without what isn't ASCII. Each kind of other character that a text holds is replaced once."""
    ascii_of = F.str_to_map(F.lit("\n".join(f"{a}\t{b}" for a, b in _ASCII.items())), F.lit("\n"), F.lit("\t"))  # folded to one literal
    others = F.array_distinct(F.regexp_extract_all(c, F.lit(r"([^\x00-\x7F])"), F.lit(1)))
    return F.aggregate(others, F.replace(c, F.lit("`"), F.lit("'")), lambda text, x: F.replace(text, x, F.coalesce(ascii_of[x], F.lit(""))))


def norm(c: Column) -> Column:
    """Upper case without accents; & reads ET; all else that is no letter or digit is one space. Null reads empty."""
    c = F.replace(F.upper(plain(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" ET "))
    return F.trim(F.regexp_replace(c, "[^A-Z0-9]+", " "))


class _PlainOf(dict):
    """What str.translate puts for a character: plain()'s letters for those in its table, nothing for others beyond ASCII."""

    def __missing__(self, code: int) -> int | str:
        return code if code < 0x80 else ""


_PLAIN_OF = _PlainOf({ord(x): letters for x, letters in _ASCII.items()})


def norm_strings(texts: pa.Array) -> pa.Array:
    """norm() of an Arrow column: the words of each text, joined. Texts in ASCII, the most of them, skip the table."""
    word = re.compile("[A-Z0-9]+")

    def normed(text: str | None) -> str:
        text = text or ""
        letters = text if text.isascii() else text.translate(_PLAIN_OF)
        return " ".join(word.findall(letters.upper().replace("&", " ET ")))

    return pa.array((normed(x) for x in texts.to_pylist()), pa.string())


def norm_arrow(c: Column) -> Column:
    return F.arrow_udf(norm_strings, "string")(c)


def _single(word: Column) -> Column:
    return word.rlike("^[A-Z]$")


def key(c: Column) -> Column:
    """A name's key: single letters in a row joined, abbreviations in full, ET dropped, legal forms dropped at both ends."""
    raw = F.split(norm(c), " ")
    glued = F.transform(raw, lambda w, i: F.concat(F.when(_single(w) & F.coalesce(_single(F.get(raw, i - 1)), F.lit(False)), "").otherwise(" "), w))
    full = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS for x in pair])
    words = F.transform(F.split(F.array_join(glued, ""), " "), lambda w: F.coalesce(full[w], w))
    words = F.filter(words, lambda w: ~w.isin("", "ET"))
    others = F.filter(F.transform(words, lambda w, i: F.when(~w.isin(*FORMS), i)), lambda i: i.isNotNull())
    first = F.array_min(others)
    return F.when(first.isNull(), "").otherwise(F.array_join(F.slice(words, first + 1, F.array_max(others) - first + 1), " "))


def compact(k: Column) -> Column:
    return F.replace(k, F.lit(" "), F.lit(""))


def department(postcode: Column) -> Column:
    return F.substring(postcode, 1, 2)


def address_key(*parts: Column) -> Column:
    """Upper-case parts with one space between; empty parts keep their place."""
    out = F.coalesce(parts[0], F.lit(""))
    for p in parts[1:]:
        out = F.concat(out, F.lit(" "), F.coalesce(p, F.lit("")))
    return F.upper(F.trim(out))


def unmasked(c: Column) -> Column:
    """Masked and empty values are null."""
    return F.nullif(F.nullif(c, F.lit("[ND]")), F.lit(""))


def rate_text(rate: Column) -> Column:
    """66.50 reads 66,5 % with a no-break space."""
    s = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", rate), "0+$", ""), r"\.$", "")
    return F.concat(F.replace(s, F.lit("."), F.lit(",")), F.lit(" %"))


def percentage(text: Column) -> Column:
    """`51,5 %` reads 51.5; what is no number reads null."""
    return F.regexp_replace(F.regexp_replace(text, "[%\\s ]", ""), ",", ".").try_cast("double")


def grouped_siren(siren: Column) -> Column:
    return F.regexp_replace(siren, r"^(\d{3})(\d{3})(\d{3})$", "$1 $2 $3")


def safe_cell(c: Column) -> Column:
    """A cell that a spreadsheet would read as a formula gets an apostrophe."""
    return F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def same_town(town: Column, city: Column) -> Column:
    """The city itself or one of its numbered districts."""
    rest = F.substring_index(F.substring(town, F.length(city) + 2, F.lit(10_000)), " ", 1)
    return (F.length(city) > 0) & ((town == city) | (F.startswith(town, F.concat(city, F.lit(" "))) & rest.rlike("^[0-9]+$")))


def cities_of(town: Column) -> Column:
    """Every city that same_town() finds for a town: itself, and what stands before each word of digits."""
    words = F.split(town, " ")
    before = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda k: F.when((k > 0) & F.get(words, k).rlike("^[0-9]+$"), F.array_join(F.slice(words, 1, k), " ")))
    return F.array_distinct(F.filter(F.concat(F.array(town), before), lambda c: c != ""))


def fingerprint(c: Column, secret: bytes) -> Column:
    """HMAC-SHA-256 of the trimmed upper-case name, in hex. The secret travels in the function, never in the plan's text."""
    import hashlib
    import hmac

    def hexed(name: str | None) -> str | None:
        return None if name is None else hmac.new(secret, name.strip().upper().encode(), hashlib.sha256).hexdigest()

    return F.pandas_udf(lambda names: names.map(hexed), "string")(c)


def shown_date(day: Column) -> Column:
    """JJ/MM/AAAA."""
    return F.date_format(day, "dd/MM/yyyy")


def paris_day(at: Column) -> Column:
    """The day in Paris of a moment given in UTC."""
    return F.to_date(F.from_utc_timestamp(at, "Europe/Paris"))


def sort_key(text: Column) -> Column:
    """What texts are sorted by: without accents or case, and numbers by their size, those of more than 20 digits by their length first."""
    parts = F.regexp_extract_all(F.upper(plain(text)), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def ordered(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+", "")
        long = F.concat(F.lit(":"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        return F.when(~x.rlike("^[0-9]"), x).when(F.length(digits) > 20, long).otherwise(F.lpad(digits, 20, "0"))

    return F.array_join(F.transform(parts, ordered), "")
