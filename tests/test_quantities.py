"""Reading numbers and units."""

import pytest

from brinework.functions.quantities import leading_unit, read, trailing_unit, unit_in_quote, unit_of


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        ("725,00", 725, 725),
        ("9 731 кгс/см²", 9731, 9731),
        ("1 737 147", 1737147, 1737147),
        ("от 14.5 до 18.5 МПa", 14.5, 18.5),
        ("2,3184–2,1000", 2.1, 2.3184),
        ("725.00±58,00", 667, 783),
        ("8,3209e4 +/- 6 657", 83209 - 6657, 83209 + 6657),
        ("167 184–1.8443e5", 167184, 184430),
        ("1,2–1,5·10^4", 12000, 15000),
        ("5.5217·10⁴", 55217, 55217),
        ("1,07 10³ МПа", 1.07, 1.07),
        ("не более 6,43", None, 6.43),
        ("at least 7 m", 7, None),
        ("<0,4696 rad", None, 0.4696),
        ("≥ 5", 5, None),
        ("ок. 790,30", 790.3, 790.3),
        ("between 32,02 and 35,15", 32.02, 35.15),
        ("12 … 9", 9, 12),
    ],
)
def test_bounds(text, low, high):
    found = read(text)
    for seen, meant in ((found.low, low), (found.high, high)):
        assert seen is None if meant is None else seen == pytest.approx(meant)


@pytest.mark.parametrize("text", [None, "", " ", "—", "нет данных", "?"])
def test_no_number(text):
    assert read(text) is None


@pytest.mark.parametrize(
    ("text", "kind", "value", "common"),
    [
        ("МПa", "stress", 1, 1e6),
        ("MН/м2", "stress", 1, 1e6),
        ("[кГс/кв.см]", "stress", 1, 98066.5),
        (" 10³ МПа", "stress", 2, 2e9),
        ("·10³ кПа,", "stress", 1, 1e6),
        ("тыс. кПа", "stress", 1, 1e6),
        ("lb/ft³", "density", 1, 16.018463),
        ("кН/м³", "density", 1, 101.97162),
        ("мм/мес.", "rate", 1, 0.012),
        ("mm/day", "rate", 1, 0.36525),
        ("град. C", "temperature", 20, 20),
        ("F", "temperature", 212, 100),
        ("К", "temperature", 273.15, 0),
        ("рад", "angle", 1, 57.29578),
        ("(проц.)", "fraction", 5, 0.05),
        ("1", "fraction", 0.5, 0.5),
        ("лет", "duration", 1, 365.25),
        ("ч", "duration", 24, 1),
    ],
)
def test_units(text, kind, value, common):
    assert unit_of(text, kind).common(value) == pytest.approx(common, rel=1e-6)


def test_places():
    assert leading_unit(" кгс/см² (сухие)", "stress").factor == pytest.approx(98066.5)
    assert trailing_unit("Глубина залегания, м", "length").factor == 1
    assert trailing_unit("скорость оседания [мм/год]", "rate").factor == pytest.approx(1e-3)
    assert trailing_unit("глубина залегания", "length") is None
    assert unit_in_quote("принято: влажность 2.21%", "2.21", "fraction").factor == 0.01
    assert unit_of("-", "stress") is None and unit_of("м", "stress") is None
