"""Dictionary codes of the dimension attributes, as expressions on the strings and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The region names in the order of their codes.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
CATEGORIES_PER_MFGR, BRANDS_PER_CATEGORY, CITIES_PER_NATION = 5, 40, 10
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def region_code(name: Column) -> Column:
    """-1 for no region's name."""
    return (F.array_position(F.array(*map(F.lit, REGIONS)), name) - 1).cast("int")


def region_name(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, REGIONS)), code)


def city_code(nation_code: Column, city: Column) -> Column:
    """A city is its nation's name, cut or filled to nine characters, and a digit."""
    return (nation_code * CITIES_PER_NATION + F.substring(city, 10, 1).cast("int")).cast("int")


def city_name(nation: Column, digit: Column) -> Column:
    return F.concat(F.rpad(nation, 9, " "), digit.cast("string"))


def mfgr_code(mfgr: Column) -> Column:
    """MFGR#m."""
    return F.substring(mfgr, 6, 1).cast("int") - 1


def category_code(category: Column) -> Column:
    """MFGR#mc."""
    return (mfgr_code(category) * CATEGORIES_PER_MFGR + F.substring(category, 7, 1).cast("int") - 1).cast("int")


def brand_code(brand: Column) -> Column:
    """MFGR#mcb, b from 1 to 40."""
    return (category_code(brand) * BRANDS_PER_CATEGORY + F.substring(brand, 8, 2).cast("int") - 1).cast("int")


def mfgr_name(code: Column) -> Column:
    return F.concat(F.lit("MFGR#"), (code + 1).cast("string"))


def category_name(code: Column) -> Column:
    return F.concat(mfgr_name(F.floor(code / CATEGORIES_PER_MFGR).cast("int")), (code % CATEGORIES_PER_MFGR + 1).cast("string"))


def brand_name(code: Column) -> Column:
    return F.concat(category_name(F.floor(code / BRANDS_PER_CATEGORY).cast("int")), (code % BRANDS_PER_CATEGORY + 1).cast("string"))


def yearmonth_code(text: Column) -> Column:
    """Dec1997 to 199712."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(text, 1, 3))
    return (F.substring(text, 4, 4).cast("int") * 100 + month).cast("int")


def yearmonth_name(code: Column) -> Column:
    return F.concat(F.get(F.array(*map(F.lit, MONTHS)), code % 100 - 1), F.floor(code / 100).cast("string"))


def date_code(day: Column) -> Column:
    """yyyymmdd."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).cast("int")
