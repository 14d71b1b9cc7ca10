"""Reading printed quantities: numbers, ranges and units in several notations."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache, wraps
from typing import NamedTuple

G = 9.80665
YEAR = 365.25
MONTH = YEAR / 12

# Factor (and offset added before it) from each printed unit to the kind's common unit.
_UNITS: dict[str, dict[str, float | tuple[float, float]]] = {
    "stress": {
        "Pa": 1, "Па": 1, "N/m2": 1, "Н/м2": 1, "kPa": 1e3, "кПа": 1e3, "kN/m2": 1e3, "кН/м2": 1e3, "MPa": 1e6, "МПа": 1e6, "N/mm2": 1e6, "Н/мм2": 1e6,
        "MN/m2": 1e6, "МН/м2": 1e6, "GPa": 1e9, "ГПа": 1e9, "bar": 1e5, "бар": 1e5, "mbar": 100, "мбар": 100, "atm": 101325, "атм": 101325, "psi": 6894.757293168, "lbf/in2": 6894.757293168, "ksi": 6894757.293168,
        "kgf/cm2": G * 1e4, "кгс/см2": G * 1e4, "кГс/кв.см": G * 1e4, "кгс/кв.см": G * 1e4, "kgf/mm2": G * 1e6, "кгс/мм2": G * 1e6, "tf/m2": G * 1e3, "тс/м2": G * 1e3, "kgf/m2": G, "кгс/м2": G,
    },
    "density": {
        "kg/m3": 1, "кг/м3": 1, "кг/куб.м": 1, "g/cm3": 1e3, "г/см3": 1e3, "г/куб.см": 1e3, "g/cc": 1e3, "t/m3": 1e3, "т/м3": 1e3, "т/куб.м": 1e3, "kg/l": 1e3, "кг/л": 1e3, "lb/ft3": 16.018463373960142,
        "kN/m3": 1e3 / G, "кН/м3": 1e3 / G, "MN/m3": 1e6 / G, "МН/м3": 1e6 / G, "N/m3": 1 / G, "Н/м3": 1 / G, "kgf/m3": 1, "кгс/м3": 1, "tf/m3": 1e3, "тс/м3": 1e3, "gf/cm3": 1e3, "гс/см3": 1e3, "lbf/ft3": 16.018463373960142,
    },
    "length": {
        "m": 1, "м": 1, "metre": 1, "metres": 1, "meter": 1, "meters": 1, "метр": 1, "метра": 1, "метров": 1, "mm": 1e-3, "мм": 1e-3, "cm": 1e-2, "см": 1e-2, "dm": 0.1, "дм": 0.1, "km": 1e3, "км": 1e3, "µm": 1e-6, "мкм": 1e-6,
        "ft": 0.3048, "feet": 0.3048, "foot": 0.3048, "фут": 0.3048, "фута": 0.3048, "футов": 0.3048, "in": 0.0254, "inch": 0.0254, "дюйм": 0.0254, "yd": 0.9144,
    },
    "rate": {
        "m/a": 1, "m/yr": 1, "m/year": 1, "м/год": 1, "м/г": 1, "cm/a": 1e-2, "cm/yr": 1e-2, "cm/year": 1e-2, "см/год": 1e-2, "см/г": 1e-2, "mm/a": 1e-3, "mm/yr": 1e-3, "mm/year": 1e-3, "мм/год": 1e-3, "мм/г": 1e-3,
        "mm/month": 12e-3, "мм/мес": 12e-3, "мм/месяц": 12e-3, "cm/month": 0.12, "см/мес": 0.12, "m/month": 12, "м/мес": 12, "mm/d": YEAR * 1e-3, "mm/day": YEAR * 1e-3, "мм/сут": YEAR * 1e-3, "мм/день": YEAR * 1e-3, "cm/day": YEAR * 1e-2, "см/сут": YEAR * 1e-2, "m/day": YEAR, "м/сут": YEAR,
    },
    "angle": {"deg": 1, "degree": 1, "degrees": 1, "°": 1, "град": 1, "градус": 1, "градуса": 1, "градусов": 1, "rad": 180 / math.pi, "рад": 180 / math.pi, "mrad": 0.18 / math.pi, "мрад": 0.18 / math.pi},
    "fraction": {"1": 1, "fraction": 1, "д.ед": 1, "доли ед": 1, "доли единицы": 1, "доля": 1, "%": 0.01, "percent": 0.01, "per cent": 0.01, "проц": 0.01, "процентов": 0.01, "процента": 0.01, "‰": 0.001, "permille": 0.001, "промилле": 0.001, "ppm": 1e-6},
    "temperature": {"°C": (0, 1), "degC": (0, 1), "deg C": (0, 1), "C": (0, 1), "град. C": (0, 1), "град C": (0, 1), "K": (-273.15, 1), "F": (-32, 5 / 9), "°F": (-32, 5 / 9), "degF": (-32, 5 / 9), "°K": (-273.15, 1)},
    "duration": {
        "d": 1, "day": 1, "days": 1, "сут": 1, "суток": 1, "сутки": 1, "день": 1, "дня": 1, "дней": 1, "h": 1 / 24, "hr": 1 / 24, "hour": 1 / 24, "hours": 1 / 24, "ч": 1 / 24, "час": 1 / 24, "часа": 1 / 24, "часов": 1 / 24,
        "min": 1 / 1440, "мин": 1 / 1440, "минут": 1 / 1440, "s": 1 / 86400, "с": 1 / 86400, "сек": 1 / 86400, "a": YEAR, "yr": YEAR, "year": YEAR, "years": YEAR, "год": YEAR, "года": YEAR, "лет": YEAR, "month": MONTH, "months": MONTH, "мес": MONTH, "месяц": MONTH, "месяцев": MONTH, "week": 7, "weeks": 7, "нед": 7,
    },
}

_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
# Letters of one shape in two scripts; a unit is compared with all of them in one script.
_SHAPES = str.maketrans("aceopxmhktb", "асеорхмнктв")
_SPACES = " \u00a0\u202f\u2009\u2007\u2002\u2003\u2005\u3000\t"
_GROUP = "[" + _SPACES + "]"
_NUMBER = rf"(?:\d{{1,3}}(?:{_GROUP}\d{{3}})+(?!\d)|\d+)(?:[.,]\d+)?"
_POWER = r"(?:\s*[·×⋅*xх]\s*10\^?\(?([-−+]?\d+)\)?|[eEеЕ]([-+−]?\d+))"
_TERM = re.compile(rf"({_NUMBER}){_POWER}?")
_BETWEEN = re.compile(r"\s*(?:[-–—−÷…]|\.\.\.?|\bto\b|\bдо\b|\band\b|\bи\b|\bbis\b|\bund\b)\s*$", re.I)
_ABOUT = re.compile(r"\s*(?:±|\+\s*/?\s*[-−–]|\+-)\s*$")
_LEAST = re.compile(r"(?:≥|>=?|⩾|не\s+менее|не\s+ниже|не\s+меньше|более|больше|свыше|выше|at\s+least|no\s+less\s+than|not\s+less\s+than|more\s+than|over|above|min\.|mindestens|от)\s*$", re.I)
_MOST = re.compile(r"(?:≤|<=?|⩽|не\s+более|не\s+выше|не\s+больше|не\s+свыше|менее|меньше|ниже|до|up\s+to|at\s+most|no\s+more\s+than|not\s+more\s+than|less\s+than|below|under|max\.|höchstens|bis)\s*$", re.I)
_TEN = re.compile(r"10([⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+)")
_SCALE = re.compile(r"^(?:[·×⋅*xх]\s*)?10\^?\(?([-−+]?\d+)\)?\s*[·×⋅*]?\s*(?=\D)")
_WORD_SCALE = re.compile(r"^(тыс|thousand|млн|million|млрд)\.?\s*", re.I)
_WORDS = {"тыс": 1e3, "thousand": 1e3, "млн": 1e6, "million": 1e6, "млрд": 1e9}


def _fold(unit: str) -> str:
    unit = unit.translate(_SUPER).replace("º", "°").replace("˚", "°").replace("µ", "μ").replace("^", "")
    return re.sub(r"[\s.]+", "", unit).lower().translate(_SHAPES)


#: (kind, folded unit) -> (offset, factor, name)
_FOLDED: dict[tuple[str, str], tuple[float, float, str]] = {}
#: Units of one scale go by one name.
_NAMES: dict[tuple[str, float, str], str] = {}
for _kind, _units in _UNITS.items():
    for _name, _to in _units.items():
        _scale = _to if isinstance(_to, tuple) else (0.0, float(_to))
        _NAMES.setdefault((_kind, _scale[0], f"{_scale[1]:.6g}"), _name)
        _FOLDED.setdefault((_kind, _fold(_name)), (*_scale, _NAMES[_kind, _scale[0], f"{_scale[1]:.6g}"]))
_LONGEST = max(len(u) for _, u in _FOLDED)


def remembered(read: Callable) -> Callable:
    """Keeps the answers to short texts, which corpora repeat all the time; long ones are read each time."""
    short = lru_cache(maxsize=50_000)(read)

    @wraps(read)
    def answer(text: str | None, kind: str):
        return short(text, kind) if text is None or len(text) <= 64 else read(text, kind)

    return answer


class Unit(NamedTuple):
    offset: float
    factor: float
    name: str

    def common(self, value: float) -> float:
        return (value + self.offset) * self.factor


class Quantity(NamedTuple):
    """Bounds as printed, and what stands behind the number."""

    low: float | None
    high: float | None
    rest: str


@remembered
def unit_of(text: str | None, kind: str) -> Unit | None:
    """The unit of the kind that the text is, brackets, blanks and trailing marks apart; None if it is none."""
    if not text:
        return None
    text = _TEN.sub(lambda m: "10^" + m.group(1).translate(_SUPER), text).strip(_SPACES + "\n")
    while text and (text[0] in "([{" and text[-1:] in ")]}," or text[-1] in ",;:" or text[0] in ",;:"):
        text = text.strip(",;:" + _SPACES)
        if text and text[0] in "([{" and text[-1] in ")]}":
            text = text[1:-1].strip(_SPACES)
    scale = 1.0
    if kind != "fraction" and (m := _SCALE.match(text)) and len(m.group(1)) <= 3:
        scale, text = 10.0 ** int(m.group(1).replace("−", "-")), text[m.end() :]
    elif m := _WORD_SCALE.match(text):
        scale, text = _WORDS[m.group(1).lower()], text[m.end() :]
    found = _FOLDED.get((kind, _fold(text)))
    if not found:
        return None
    factor = found[1] * scale
    return Unit(found[0], factor, found[2] if scale == 1 else _NAMES.get((kind, found[0], f"{factor:.6g}"), f"{scale:g} {found[2]}"))


def leading_unit(text: str, kind: str) -> Unit | None:
    """The longest unit of the kind that the text starts with."""
    return _leading(text.lstrip(_SPACES)[: _LONGEST + 24], kind)


@remembered
def _leading(text: str, kind: str) -> Unit | None:
    for end in range(len(text), 0, -1):
        if end < len(text) and (text[end - 1].isalnum() and text[end].isalnum() or text[end] in "/²³^"):
            continue
        if unit := unit_of(text[:end], kind):
            return unit
    return None


@remembered
def trailing_unit(text: str | None, kind: str) -> Unit | None:
    """The unit in a heading: in its last brackets, or behind its last comma."""
    if not text:
        return None
    text = text.strip()
    if m := re.search(r"[(\[]([^()\[\]]*)[)\]]\s*$", text):
        return unit_of(m.group(1), kind)
    return unit_of(text.rpartition(",")[2], kind) if "," in text else None


def _value(m: re.Match) -> tuple[float, int | None]:
    number = float(re.sub(_GROUP, "", m.group(1)).replace(",", "."))
    power = m.group(2) or m.group(3)
    return number, int(power.replace("−", "-")) if power else None


def read(text: str | None) -> Quantity | None:
    """The first quantity of a text; None without a number, or with one beyond all bounds.

    Comma and point are decimal marks, blanks of any kind group thousands.  A
    range has both bounds, in either order; a number with a tolerance its two
    ends; a one-sided statement one bound; any other number both.
    """
    if not text:
        return None
    try:
        found = _read(_TEN.sub(lambda m: "10^" + m.group(1).translate(_SUPER), text))
    except OverflowError:
        return None
    return found if found and all(b is None or math.isfinite(b) for b in found[:2]) else None


def _read(text: str) -> Quantity | None:
    first = _TERM.search(text)
    if not first:
        return None
    before = text[: first.start()]
    sign = -1.0 if re.search(r"(?:^|[\s=:(<>≤≥~≈])[-−]$", before) else 1.0
    if sign < 0:
        before = before[:-1]
    a, power = _value(first)
    a *= sign
    second = _TERM.search(text, first.end())
    gap = text[first.end() : second.start()] if second else ""
    if second and not gap.strip(_SPACES) and text[second.start() : second.start() + 3] == "10^":
        second = None
    if second and len(gap) <= 24 and (_ABOUT.search(gap) or _BETWEEN.search(gap)):
        b, other = _value(second)
        # "1.2–1.5·10^4": a power behind the second number also holds for a first one of the same magnitude.
        shared = other if power is None and other is not None and abs(a) < 10 * b else power
        if re.search(r"^\s*10\^", text[second.start() :]):
            return _single(text, before, first, a, power)
        a, b = (v * 10.0 ** (p or 0) for v, p in ((a, shared), (b, other)))
        rest = text[second.end() :]
        if _ABOUT.search(gap):
            return Quantity(a - b, a + b, rest)
        return Quantity(min(a, b), max(a, b), rest)
    return _single(text, before, first, a, power)


def _single(text: str, before: str, first: re.Match, a: float, power: int | None) -> Quantity:
    a *= 10.0 ** (power or 0)
    rest = text[first.end() :]
    if _MOST.search(before):
        return Quantity(None, a, rest)
    if _LEAST.search(before):
        return Quantity(a, None, rest)
    return Quantity(a, a, rest)


def unit_in_quote(quote: str | None, printed: str | None, kind: str) -> Unit | None:
    """The unit behind the printed value where the quote repeats it, else behind the quote's first quantity."""
    if not quote:
        return None
    printed = (printed or "").strip()
    at = quote.find(printed) if printed else -1
    if at >= 0 and (unit := leading_unit(quote[at + len(printed) :], kind)):
        return unit
    found = read(quote)
    return leading_unit(found.rest, kind) if found else None
