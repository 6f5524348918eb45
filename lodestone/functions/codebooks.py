"""Labels of coded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of education, career sectors, target types and genders with their labels, and countries left out of analyses.
ISCED = {5: "Short-cycle tertiary", 6: "Bachelor / equivalent", 7: "Master / long first degree", 8: "Doctorate"}
SECTOR = {
    1: "Central government executive",
    2: "Public administration",
    3: "Public sector orgs & industries",
    4: "Politics / political office (non-executive)",
    5: "Judiciary & oversight",
    6: "Private & third sector",
    7: "International organisations",
    8: "Other / none",
}
TARGET_TYPE = {
    "person": "Individual person",
    "government": "Government / executive",
    "administration": "Public administration",
    "political_party": "Political party",
    "public_institution": "Public institution",
    "foreign_country_or_govt": "Foreign country / government",
    "international_org": "International organisation",
    "media": "Media",
    "social_group": "Social group",
    "other": "Other",
    "unclear_or_none": "Unclear / none",
}
GENDER = {"male": "Male", "female": "Female"}
EXCLUDED_COUNTRIES = ("IS", "BA", "GR", "LV", "EE", "RS")


def label(c: Column, book: dict) -> Column:
    """The label of a code; null for others."""
    return F.create_map(*[F.lit(x) for pair in book.items() for x in pair])[c]


def sectors_to_labels(c: Column) -> Column:
    """Labels of a comma-separated list of sectors in its order, unknown ones left out; an empty list for null or empty text."""
    codes = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    return F.filter(F.transform(codes, lambda x: label(x, SECTOR)), lambda x: x.isNotNull())
