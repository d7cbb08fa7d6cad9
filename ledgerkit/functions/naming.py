"""Column-name normalisation (P01-P03). Names are metadata: plain Python on the
driver, applied with one ``toDF``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ledgerkit import constants as K

_RUN = re.compile("[a-z0-9]+")


def slugify(value: str) -> str:
    """The runs of ASCII letters and digits of the decomposed lower-case name,
    joined by ``_``; a name without any gets the default."""
    decomposed = unicodedata.normalize("NFKD", value)
    plain = "".join(c for c in decomposed if c.isascii()).lower()
    return "_".join(_RUN.findall(plain)) or K.EMPTY_SLUG


def deduplicate(names: Sequence[str]) -> list[str]:
    """``x, x, x`` -> ``x, x_2, x_3``; a generated name never collides with a
    name that is already taken (``a, a, a_2`` -> ``a, a_3, a_2``)."""
    taken = set(names)
    seen: dict[str, int] = {}
    used: set[str] = set()
    out: list[str] = []
    for name in names:
        if name not in used:
            out.append(name)
            used.add(name)
            seen.setdefault(name, 1)
            continue
        n = seen.get(name, 1)
        while True:
            n += 1
            candidate = f"{name}_{n}"
            if candidate not in used and candidate not in taken:
                break
        seen[name] = n
        out.append(candidate)
        used.add(candidate)
    return out


def standard_names(columns: Sequence[str]) -> list[str]:
    """P03 on a list of names."""
    return deduplicate([slugify(str(c).strip()) for c in columns])


def standardize_columns(df: DataFrame) -> DataFrame:
    """Every column renamed to unique ASCII snake_case."""
    return df.toDF(*standard_names(df.columns))
