"""Text clean-up as built-in column expressions, so it stays inside code generation."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of "not available".
NA_TOKENS = ("", "NA", "N/A", "NaN", "NULL")
# Fixed value: one source also writes a backslash-N.
NA_TOKENS_BACKSLASH = NA_TOKENS + ("\\N",)

# Letters without a canonical decomposition, and common punctuation.
ASCII_SINGLE = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i",
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "\u00a0": " ", "¡": "!", "¿": "?",
}
ASCII_MULTI = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "—": "--", "…": "...", "«": "<<", "»": ">>",
}

# Greek and Cyrillic letters in Latin ones, lower case; capitals follow.
SCRIPT_SINGLE = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n",
    "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "ы": "y", "э": "e", "і": "i", "ь": "'", "ъ": "'",
}
SCRIPT_MULTI = {
    "θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ю": "iu", "я": "ia", "є": "ie",
}


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def collapse_whitespace(col: Column) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def normalize_na(col: Column, tokens=NA_TOKENS) -> Column:
    """Null where the text is one of ``tokens``."""
    return F.when(~col.isin(*tokens), col)


def clean_strings(df: DataFrame, na_tokens=NA_TOKENS, cols: list[str] | None = None) -> DataFrame:
    """Both steps on every top-level string column (or ``cols``), in one projection."""
    chosen = set(string_columns(df) if cols is None else cols)
    return df.select(*[
        normalize_na(collapse_whitespace(F.col(_q(c))), na_tokens).alias(c) if c in chosen else F.col(_q(c))
        for c in df.columns
    ])


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Letters that decompose to one Latin, Greek or Cyrillic letter plus marks; the marks themselves are deleted."""
    single = SCRIPT_SINGLE | {k.upper(): v.upper() for k, v in SCRIPT_SINGLE.items() if k.upper() != k and k != "ς"}
    src, dst = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x0370, 0x0460), *range(0x1E00, 0x2000)]:
        base = "".join(ch for ch in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(ch))
        latin = single.get(base, base)
        if latin != chr(code) and len(base) == 1 and latin.isascii():
            src.append(chr(code))
            dst.append(latin)
    for ch, ascii_ch in ASCII_SINGLE.items():
        src.append(ch)
        dst.append(ascii_ch)
    marks = "".join(chr(c) for c in range(0x0300, 0x0370))
    return "".join(src) + marks, "".join(dst)


def strip_accents(col: Column) -> Column:
    """Latin, Greek and Cyrillic text to ASCII; null or empty gives null. Other scripts are left as they are."""
    src, dst = _accent_table()
    cases = {c: x for ch, latin in SCRIPT_MULTI.items() for c, x in ((ch, latin), (ch.upper(), latin.capitalize()))}
    latin = _once(_spell(F.translate(col, src, dst), ASCII_MULTI),
                  lambda x: F.when(x.rlike(r"[\u0370-\u04FF]"), _spell(x, cases)).otherwise(x))
    # Pure ASCII text skips the passes above.
    return F.when(col != "", F.when(col.rlike(r"[^\x00-\x7F]"), latin).otherwise(col))


def _spell(text: Column, spellings: dict[str, str]) -> Column:
    for ch, ascii_text in spellings.items():
        text = F.replace(text, F.lit(ch), F.lit(ascii_text))
    return text


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a condition Spark repeats whatever is named twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_id(col: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), col)


def split_title_year(df: DataFrame, col: str, year_col: str) -> DataFrame:
    """``T (1999)`` to title ``T`` and year 1999; without a year the title stays and the year is null."""
    year = F.regexp_extract(F.col(col), r"\((\d{4})\)$", 1).try_cast("int")
    title = F.regexp_replace(F.col(col), r"\s*\(\d{4}\)$", "")
    return df.withColumns({year_col: year, col: title})


def split_to_array(col: Column, sep: str) -> Column:
    """Split on a literal separator; null in, null out."""
    return F.split(col, "\\Q" + sep + "\\E")


def clean_array(col: Column, na_tokens=("",)) -> Column:
    """The array without nulls and without ``na_tokens``."""
    return F.filter(col, lambda x: x.isNotNull() & ~x.isin(*na_tokens))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


quoted = _q
