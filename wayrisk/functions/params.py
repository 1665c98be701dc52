"""Plain-Python reading and checking of parameters, done before any plan is built."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from wayrisk.schemas import INGEST_MODES, VALID_YEARS

CODECS = {"snappy", "gzip", "zstd", "brotli", "lz4"}


def check_years(years: Iterable[int]) -> None:
    lo, hi = VALID_YEARS
    wrong = [y for y in years if y < lo or y > hi]
    if wrong:
        raise ValueError(f"years outside {lo}-{hi}: {wrong}")


def check_months(months: Iterable[int]) -> None:
    wrong = [m for m in months if m < 1 or m > 12]
    if wrong:
        raise ValueError(f"months outside 1-12: {wrong}")


def check_ingest_mode(mode: str) -> str:
    cleaned = mode.strip().lower()
    if cleaned not in INGEST_MODES:
        raise ValueError(f"mode must be one of {INGEST_MODES}, not {mode!r}")
    return cleaned


def check_ingest_request(years: Sequence[int], months: Sequence[int], mode: str) -> str:
    check_years(years)
    check_months(months)
    return check_ingest_mode(mode)


def radius_metres(text: str | int | float) -> int | None:
    """``"500m"``, ``"1km"``, ``"750"`` to whole metres; ``auto``/``max``/blank to ``None``."""
    cleaned = str(text).strip().lower()
    if cleaned in ("", "auto", "max"):
        return None
    found = re.fullmatch(r"(\d+(?:\.\d+)?)\s*(m|km)?", cleaned)
    if not found:
        raise ValueError(f"cannot read radius {text!r}")
    metres = float(found[1]) * (1000.0 if found[2] == "km" else 1.0)
    if metres <= 0:
        raise ValueError("radius must be positive")
    return round(metres)


def radii_list(text: str | None) -> list[float]:
    """Comma list of radii in metres; entries that are no positive number are ignored."""
    values = set()
    for item in (text or "").split(","):
        try:
            number = float(item)
        except ValueError:
            continue
        if number > 0:
            values.add(number)
    return sorted(values)


def crash_column(radius: float) -> str:
    return f"crashes_within_{int(radius)}m"


def rate_column(radius: float) -> str:
    return crash_column(radius) + "_per_100k_trips"


def radii_in_columns(columns: Iterable[str]) -> list[int]:
    """Radii for which a crash count (or rate) column is present."""
    before, after = crash_column(0).split("0")
    as_rate = rate_column(0).removeprefix(crash_column(0))
    counts = (c.removesuffix(as_rate) for c in columns)
    middles = (c[len(before) : -len(after)] for c in counts if c.startswith(before) and c.endswith(after))
    return sorted({int(m) for m in middles if m.isdecimal() and m.isascii()})


def choose_radius(available: Iterable[int], wanted: str | int | float | None, strict: bool = False) -> int:
    """Wanted radius if there, else 500, else the largest; ``auto`` is the largest.

    With ``strict`` a wanted radius that is missing is an error.
    """
    there = sorted(set(available))
    if not there:
        raise ValueError("no crash-count columns present")
    radius = radius_metres(wanted if wanted is not None else "auto")
    if radius is None:
        return there[-1]
    if radius in there:
        return radius
    if strict:
        raise ValueError(f"radius {radius} m not among {there}")
    return 500 if 500 in there else there[-1]


def months_spec(text: str | None) -> list[int] | None:
    """``"1-3,10"`` to ``[1, 2, 3, 10]``; ranges may be given in either direction."""
    if text is None or not str(text).strip():
        return None
    months: set[int] = set()
    for item in str(text).split(","):
        if not item.strip():
            continue
        ends = [int(x) for x in item.split("-", 1)]
        months.update(range(min(ends), max(ends) + 1))
    check_months(months)
    return sorted(months)


def int_list(text: str | None) -> list[int] | None:
    """Numbers split by blanks or commas, or ``None`` when there are none."""
    found = [int(x) for x in re.split(r"[\s,]+", text or "") if x]
    return found or None


def months_key(months: Iterable[int]) -> str:
    return ",".join(str(m) for m in sorted(months))


def codec(text: str) -> str:
    cleaned = text.strip().lower()
    if cleaned in ("", "none", "off", "no", "false"):
        return "uncompressed"
    if cleaned in CODECS:
        return cleaned
    raise ValueError(f"unknown compression {text!r}")


def pick_column(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """First candidate present in ``columns``, ignoring case, spelled as in ``columns``."""
    spelled = {c.lower(): c for c in columns}
    return next((spelled[c.lower()] for c in candidates if c.lower() in spelled), None)


def require_columns(columns: Iterable[str], needed: Iterable[str], what: str) -> None:
    missing = sorted(set(needed) - set(columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")


# --- header texts ---------------------------------------------------------
def standard_name(header: str) -> str:
    """Lower-case snake form of a trip-file header."""
    plain = header.strip().lower().replace("﻿", "")
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z_]", "_", plain)).strip("_")


def crash_name(header: str) -> str:
    return re.sub(r"[ \-/]", "_", header.strip().lower())


def clean_header(cells: Sequence[str | None]) -> list[str]:
    """Name blanks by position and number the repeats of a name (``x``, ``x__2``, ...)."""
    seen: dict[str, int] = {}
    names = []
    for position, cell in enumerate(cells, start=1):
        name = (cell or "").strip().lstrip("﻿") or f"col_{position}"
        nth = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        names.append(name if nth == 1 else f"{name}__{nth}")
    return names


# --- calendar -------------------------------------------------------------
def month_index(year: int, month: int) -> int:
    return 12 * year + month


def year_month(index: int) -> tuple[int, int]:
    return (index - 1) // 12, (index - 1) % 12 + 1


def shift_month(year: int, month: int, by: int) -> tuple[int, int]:
    return year_month(month_index(year, month) + by)
