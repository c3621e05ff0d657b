"""Column functions on text. Lengths count code points; white space includes Unicode separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def one_line(c: Column) -> Column:
    """Line feeds as spaces, then stripped."""
    return strip(F.regexp_replace(c, "\n", " "))


def blank_to(c: Column, default: str) -> Column:
    """``default`` for null and blank texts."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def words(c: Column) -> Column:
    """Pieces between white space, none empty."""
    return F.filter(F.split(c, rf"{SPACE}+"), lambda w: w != "")


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def last_words(c: Column, n: int) -> Column:
    """The last ``n`` words, all of them if there are fewer."""
    w = words(c)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - (n - 1), F.lit(1)), n), " ")


def sentences(c: Column, least: int = 10) -> Column:
    """Sentences of ``least`` characters or more: cut after a stop before white space and an opening character."""
    return F.filter(F.transform(F.split(c, r"""(?<=[.!?])\s+(?=[A-Z(\["'])"""), strip), lambda s: F.length(s) >= least)


def tokens(c: Column, pattern: str = r"[A-Za-z][A-Za-z\-]{2,}") -> Column:
    """Lower-case matches of ``pattern`` in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), F.lower)


def token_set(c: Column) -> Column:
    """Distinct lower-case words of four characters or more."""
    return F.array_distinct(F.transform(F.filter(words(c), lambda w: F.length(w) > 3), F.lower))


def tail_bytes(c: Column, n: int = 8192) -> Column:
    """The last ``n`` bytes of the UTF-8 form, read back; a cut character becomes a replacement sign."""
    b = F.encode(c, "UTF-8")
    return F.when(F.octet_length(c) <= n, c).otherwise(F.decode(F.substring(b, -n, n), "UTF-8"))


def file_stem(c: Column, n: int = 40) -> Column:
    """Signs that are neither letters nor digits as ``_``, at most ``n`` characters."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"), 1, n)


def shorten(c: Column, n: int = 14) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def slug_title(c: Column) -> Column:
    """``/`` as two underscores, underscores as spaces, each word with a capital."""
    return F.initcap(F.replace(F.replace(c, F.lit("/"), F.lit("__")), F.lit("_"), F.lit(" ")))


#: Signs with a meaning in LaTeX and how they are written.
TEX_SIGNS = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def escape_tex(c: Column) -> Column:
    """LaTeX signs escaped in one pass over the characters; null as empty."""
    m = F.create_map(*[F.lit(x) for kv in TEX_SIGNS.items() for x in kv])
    return F.coalesce(F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(m, ch), ch)), ""), F.lit(""))


def caps_share(c: Column) -> Column:
    """Share of capital letters among the letters; 0 without letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")), letters), F.lit(0.0))
