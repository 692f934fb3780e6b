"""Chinese numerals in text to digits: ranges, clock times, digit strings, runs of numbers, values, percents, fractions, ratios, dates.

A candidate is a run of numeral characters with what may belong to them. What it is decides how it is written; the first
kind that fits wins. Idioms, and runs with 几, stay as they are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

# Fixed values.
DIGITS = {"零": 0, "幺": 1, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SCALES = {"十": 10, "百": 100, "千": 1000, "万": 10_000, "亿": 100_000_000}
UNITS = {"千米每小时": "km/h", "千克": "kg", "千米": "千米", "克": "g", "米": "米"} | {u: u for u in "个只分万亿秒年月日天时钟人层楼倍块次"}
IDIOMS = """正经八百 五零二落 五零四散 五十步笑百步 乌七八糟 污七八糟 四百四病 思绪万千 十有八九 十之八九 三十而立 三十六策 三十六计 三十六行
三五成群 三百六十行 三六九等 七老八十 七零八落 七零八碎 七七八八 乱七八遭 乱七八糟 略知一二 零零星星 零七八碎 九九归一 二三其德 二三其意
无银三百两 八九不离十 百分之百 年三十 烂七八糟 一点一滴 路易十六 九三学社 五四运动 入木三分 九九八十一 三七二十一
十二五 十三五 十四五 十五五 十六五 十七五 十八五""".split()

_N = "零幺一二两三四五六七八九"
_V = _N + "十百千万"
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
_IDIOM = re.compile("|".join(IDIOMS))
_RUN = re.compile(f"(?:[几{_V}点比]|分之|(?<=[一二两三四五六七八九十])[年月日号分])+(?:(?<=[一二两三四五六七八九十百千万])(?:{_UNIT}|[a-zA-Z]+|[年月日号]))?")
_RANGES = [
    re.compile(f"(?P<base>[一二三四五六七八九]?十|[一二三四五六七八九十]+[百千万])(?P<a>[一二三四五六七八九])(?P<b>[一二三四五六七八九])(?P<more>[万千亿]?)(?P<unit>(?:{_UNIT})?)"),
    re.compile(f"(?P<a>[二三四五六七八九])(?P<b>[二三四五六七八九])(?P<scale>[十百千万亿])(?P<more>[万千百亿]?)(?P<unit>(?:{_UNIT})?)"),
]
_CLOCK = re.compile("([零一二两三四五六七八九十]+)点([零一二三四五六七八九十]+)分(?:([零一二三四五六七八九十]+)秒)?")
_DIGITS = re.compile(f"([零幺一二三四五六七八九]+(?:点[零幺一二三四五六七八九]+)*)({_UNIT}|[a-zA-Z]*)")
_SERIES = re.compile(f"((?:十[一二三四五六七八九]){{2,}}|(?:[一二三四五六七八九]百零?[一二三四五六七八九]){{2,}})({_UNIT})?")
_NUMBER = "[零一二两三四五六七八九十百千万]+(?:点[零一二三四五六七八九]+)?"
_VALUE = re.compile(f"({_NUMBER})({_UNIT}|[a-zA-Z]*)")
_DATE = re.compile("(?:([零一二三四五六七八九十]+)年)?(?:([一二三四五六七八九十]+)月)?(?:([一二三四五六七八九十]+)([日号]))?")


def whole(text: str) -> int:
    """Value of a numeral; a last digit without its scale counts for the scale below the one before it."""
    total = part = digit = 0
    below = 1
    for c in text:
        if c in DIGITS:
            digit = DIGITS[c]
            below = 1 if c == "零" else below
        elif c == "万":
            total, part, digit, below = (total + part + digit) * 10_000, 0, 0, 1000
        else:
            part += (digit or 1) * SCALES[c]
            digit, below = 0, SCALES[c] // 10
    return total + part + digit * below


def value(text: str) -> str:
    integer, _, decimals = text.partition("点")
    return str(whole(integer)) + ("." + digits(decimals) if decimals else "")


def digits(text: str) -> str:
    return "".join("." if c == "点" else str(DIGITS[c]) for c in text)


def _range(text: str) -> str | None:
    for pattern in _RANGES:
        m = pattern.fullmatch(text)
        if m and (base := m.groupdict().get("base")):
            step = SCALES[base[-1]] // 10
            low, high = (whole(base) + DIGITS[m[k]] * step for k in "ab")
            return f"{low}~{high}{m['more']}{UNITS.get(m['unit'], '')}"
        if m:
            a, b, scale, more = DIGITS[m["a"]], DIGITS[m["b"]], m["scale"], m["more"]
            if scale in "万亿" or scale == "千" and more:
                return f"{a}~{b}{scale}{more}{UNITS.get(m['unit'], '')}"
            return f"{a * SCALES[scale]}~{b * SCALES[scale]}{more}{UNITS.get(m['unit'], '')}"
    return None


def convert(text: str) -> str:
    """One candidate."""
    if "几" in text:
        return text
    if (r := _range(text)) is not None:
        return r
    if m := _CLOCK.fullmatch(text):
        return ":".join(value(x).zfill(2) for x in m.groups() if x)
    if m := _DIGITS.fullmatch(text):
        return text if m[1] == "一" else digits(m[1]) + UNITS.get(m[2], m[2])
    if m := _SERIES.fullmatch(text):
        step = "十[一二三四五六七八九]|[一二三四五六七八九]百零?[一二三四五六七八九]"
        return " ".join(value(x) for x in re.findall(step, m[1])) + UNITS.get(m[2] or "", "")
    if m := _VALUE.fullmatch(text):
        if not m[2] and len(m[1]) > 1 and m[1][-1] == "万":  # stays as a unit
            return value(m[1][:-1]) + "万"
        return value(m[1]) + UNITS.get(m[2], m[2])
    if m := re.fullmatch(f"百分之({_NUMBER})", text):
        return value(m[1]) + "%"
    if m := re.fullmatch(f"({_NUMBER})分之({_NUMBER})", text):
        return f"{value(m[2])}/{value(m[1])}"
    if m := re.fullmatch(f"({_NUMBER})比({_NUMBER})", text):
        return f"{value(m[1])}:{value(m[2])}"
    if (m := _DATE.fullmatch(text)) and any(m.groups()):
        year = (digits(m[1]) if "十" not in m[1] else value(m[1])) + "年" if m[1] else ""
        return year + (value(m[2]) + "月" if m[2] else "") + (value(m[3]) + m[4] if m[3] else "")
    return text


def normalize(text: str | None) -> str | None:
    """Text with its numerals as digits; null stays null."""
    if not text:
        return text
    safe = [m.start() for m in _IDIOM.finditer(text)]
    return _RUN.sub(lambda m: m[0] if any(max(0, m.start() - 2) <= s < m.end() for s in safe) else convert(m[0]), text)


def itn(column):
    """Column: ``normalize`` of a text column, in Arrow batches."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(normalize)

    return run(column)
