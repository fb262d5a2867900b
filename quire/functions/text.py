"""String expressions: white space, control characters, names, hashes.  Column to Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CONTROL = r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}]"
NOT_IN_FILE_NAMES = r'[/:*?"<>|\\]+'
CJK = r"[一-鿿]"
#: White space of any kind.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space as the \s of SQL patterns has it.
PLAIN_WHITE = "\t\n\f\r "
#: What ends a line, besides \n.
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]"


def let(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of the values, each computed once: an expression that is used in several places is otherwise copied to all of them."""
    bound = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.get(F.transform(F.array(bound), lambda x: body(*(x[f"v{i}"] for i in range(len(values))))), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim alone takes blanks only)."""
    return F.trim(c, F.lit(WHITE))


def strip_plain(c: Column) -> Column:
    """Without the white space of SQL patterns at both ends."""
    return strip_chars(c, PLAIN_WHITE)


def strip_chars(c: Column, chars: str) -> Column:
    """Without any of the given characters at both ends."""
    return F.trim(c, F.lit(chars))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def lower_plain(c: Column) -> Column:
    """Lower case character by character, as SQL has it: one letter for each, whatever stands next to it."""
    return F.lower(F.translate(c, "\u0130\u03a3", "i\u03c3"))


def one_blank(c: Column) -> Column:
    """White space of SQL patterns as one blank, at the ends too."""
    return F.regexp_replace(c, f"[{PLAIN_WHITE}]+", " ")


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def lines(c: Column) -> Column:
    """The lines of a text; the pattern is run only on texts that have other ends than \\n."""
    return F.split(F.when(c.rlike(LINE_ENDS), F.regexp_replace(c, LINE_ENDS, "\n")).otherwise(c), "\n", -1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def sha256(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def json_hash(c: Column) -> Column:
    """The hash of a JSON text that doesn't depend on white space or the order of keys: a variant keeps its keys sorted."""
    return sha256(F.to_json(F.try_parse_json(c)))


def excerpt(c: Column, limit: int = 240) -> Column:
    return F.substring(collapse(c), 1, limit)


def language(c: Column) -> Column:
    return F.when(c.rlike(CJK), "zh-CN").otherwise("en")


def _shortened(c: Column, most: int) -> Column:
    cut = F.rtrim(F.substring(c, 1, most), F.lit(" .-_"))
    return F.coalesce(blank_to_null(F.when(F.length(c) > most, cut).otherwise(c)), F.lit("untitled"))


def file_name(c: Column, most: int = 180) -> Column:
    """A name that file systems accept."""
    safe = F.regexp_replace(without_controls(c), NOT_IN_FILE_NAMES, "-")
    return _shortened(strip_chars(collapse(safe), " .-_"), most)


def _ascii(c: Column) -> Column:
    """Without accents and what else is not ASCII."""

    @F.pandas_udf("string")
    def decomposed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())

    return decomposed(c)


def ascii_slug(c: Column, most: int = 180) -> Column:
    """Lower-case ASCII letters and digits, joined by hyphens.  Decomposition is not a built-in: one vectorised UDF."""
    plain = _ascii(F.regexp_replace(without_controls(c), "[γΓ]", "gamma"))
    return _shortened(F.lower(strip_chars(F.regexp_replace(plain, "[^A-Za-z0-9]+", "-"), "-")), most)
