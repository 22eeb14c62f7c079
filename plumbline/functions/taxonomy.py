"""Category names as native column expressions over small literal maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import constants as K


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])


TRACKER = {raw: name for name, raws in K.TRACKER_NAMES.items() for raw in raws}
WEBSITE = {name.lower(): name for name in K.WEBSITE_CATEGORIES} | {raw: name for name, raws in K.WEBSITE_SPELLINGS.items() for raw in raws}
PRIORITY = {main: i for i, main in enumerate(K.FINE_CATEGORIES)}
FINE = {fine: main for main, fines in K.FINE_CATEGORIES.items() for fine in fines}


def tracker_category(raw: Column) -> Column:
    return F.coalesce(_map(TRACKER)[F.lower(F.trim(raw))], F.trim(raw))


def tracker_categories(raws: Column) -> Column:
    """Normalised, without blanks, each once in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(raws, F.array().cast("array<string>")), tracker_category), lambda c: c != ""))


def website_category(raw: Column) -> Column:
    return F.when(F.trim(raw) != "", F.coalesce(_map(WEBSITE)[F.lower(F.trim(raw))], F.trim(raw)))


def main_category(fine: Column) -> Column:
    """Of names joined by |, the main category of the best priority; Other for none."""
    names = F.filter(F.transform(F.split(F.coalesce(fine, F.lit("")), r"\|"), lambda v: F.trim(v)), lambda c: c != "")
    ranks = F.transform(names, lambda c: F.coalesce(_map({f: PRIORITY[m] for f, m in FINE.items()})[c], F.lit(PRIORITY["Other"])))
    order = F.array(*[F.lit(m) for m in PRIORITY])
    return F.coalesce(F.get(order, F.array_min(ranks)), F.lit("Other"))


def unknown_categories(fine: Column) -> Column:
    known = F.array(*[F.lit(f) for f in FINE])
    return F.array_except(F.filter(F.transform(F.split(F.coalesce(fine, F.lit("")), r"\|"), lambda v: F.trim(v)), lambda c: c != ""), known)
