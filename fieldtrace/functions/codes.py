"""Country names, regions and species labels."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtrace.functions.nullsafe import col, if_else, is_in
from fieldtrace.functions.text import contains, plain_upper, starts_with

UNITED_KINGDOM = "U.K. OF GREAT BRITAIN AND NORTHERN IRELAND"

# Country codes of the commune gazetteer and the names they stand for.
COUNTRY_CODES = {
    "AU": "AUSTRIA", "BL": "BELGIUM", "BY": "BELARUS", "DE": "GERMANY", "DK": "DENMARK",
    "ER": UNITED_KINGDOM, "ES": "SPAIN", "ET": "ESTONIA", "FR": "FRANCE", "GB": UNITED_KINGDOM,
    "HE": "SWITZERLAND", "HG": "HUNGARY", "IA": "ITALY", "LI": "LITHUANIA", "LV": "LATVIA",
    "NL": "NETHERLANDS", "NO": "NORWAY", "NV": "NETHERLANDS", "PL": "POLAND", "PO": "PORTUGAL",
    "RU": "RUSSIAN FEDERATION", "SF": "FINLAND", "SK": "SLOVAKIA", "SV": "SLOVENIA",
    "TU": "TURKEY", "UK": "UKRAINE",
}

# Country cells of the locality gazetteer that need another name.
LOCALITY_COUNTRIES = {"CHOLET": "FRANCE", "UK": UNITED_KINGDOM}

# Departments of the nesting regions, three regions and the two of the report.
NESTING_REGIONS = {"Ouest": ["44", "53"], "Centre": ["41", "77", "89"], "Est": ["42", "01", "51", "55"]}
MAP_REGIONS = {"West": ["44", "53"], "Center": ["41", "77", "89"], "East": ["42", "01", "51", "55"]}
REPORT_REGIONS = {"Ouest": ["44", "53"], "Est": ["01", "51"]}

# Land-cover codes and the kind of water they stand for.
WATER_KINDS = {
    "soft_wb": [411, 512], "peat": [412], "coast": [423, 522], "salt_wb": [421, 422, 521],
    "river": [511], "sea": [523],
}


# The spellings of the field tables, first match first.
def country_name(c: str | Column) -> Column:
    """Country of an observation record, upper case without accents; missing means France."""
    c = plain_upper(c)
    return (
        F.when(contains(c, "0000") | c.isNull(), "FRANCE")
        .when(contains(c, "BIELORUSSIA"), "BELARUS")
        .when(starts_with(c, "BELG"), "BELGIUM")
        .when(c == "GRECE", "GREECE")
        .when(starts_with(c, "NETHER"), "NETHERLANDS")
        .when(starts_with(c, "RUSSIA"), "RUSSIAN FEDERATION")
        .when(starts_with(c, "SWI|SUI|SWT"), "SWITZERLAND")
        .when(is_in(c, ["UK", "OK", "SCOTLAND"]), UNITED_KINGDOM)
        .when(c == "ITALIA", "ITALY")
        .otherwise(c)
    )


def mapped(c: str | Column, names: Mapping[str, str]) -> Column:
    """Replace the listed codes by their names and keep everything else."""
    lookup = F.create_map(*[F.lit(v) for v in chain(*names.items())])
    return F.coalesce(lookup[col(c)], col(c))


def labelled(c: str | Column, groups: Mapping[str, list]) -> Column:
    """Label of the group that lists the value; null for anything else."""
    out = None
    for label, values in groups.items():
        test = is_in(c, values)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def map_country(c: str | Column) -> Column:
    """Country name of a map layer in the spelling of the records."""
    return if_else(col(c) == "United Kingdom", F.lit(UNITED_KINGDOM), F.upper(col(c)))


def species_name(c: str | Column) -> Column:
    return if_else(col(c) == "AYTFER", F.lit("Aythya ferina"), F.lit("Aythya fuligula"))
