"""Country codes: ISO 3166 two- and three-letter codes and English names, as one code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmacade.functions.clean import present

# ISO 3166 alpha-2, alpha-3 and names of countries.
COUNTRIES = """
AR ARG argentina
AT AUT austria
AU AUS australia
BB BRB barbados
BE BEL belgium
BG BGR bulgaria
BR BRA brazil
CA CAN canada
CH CHE switzerland
CL CHL chile
CY CYP cyprus
CZ CZE czechia, czech republic
DE DEU germany
DK DNK denmark
EE EST estonia
ES ESP spain
FI FIN finland
FR FRA france
GB GBR united kingdom, great britain, uk, england, scotland, wales
GR GRC greece
HR HRV croatia
HU HUN hungary
IE IRL ireland, republic of ireland
IN IND india
IS ISL iceland
IT ITA italy
JP JPN japan
KE KEN kenya
LT LTU lithuania
LU LUX luxembourg
LV LVA latvia
MC MCO monaco
MT MLT malta
MX MEX mexico
NL NLD netherlands, holland
NO NOR norway
NZ NZL new zealand
PE PER peru
PK PAK pakistan
PL POL poland
PT PRT portugal
PY PRY paraguay
QA QAT qatar
RO ROU romania
SA SAU saudi arabia
SE SWE sweden
SI SVN slovenia
SK SVK slovakia
TR TUR turkey
UA UKR ukraine
US USA united states
UY URY uruguay
ZA ZAF south africa
"""

#: The two-letter code of each spelling, in upper case.
CODES = {
    spelling.strip().upper(): line.split()[0]
    for line in COUNTRIES.strip().splitlines()
    for spelling in [*line.split()[:2], *line.split(maxsplit=2)[2].split(",")]
}


#: The same as a table for other engines.
CODES_SQL = "(VALUES " + ", ".join(f"('{spelling}', '{code}')" for spelling, code in CODES.items()) + ") iso(spelling, code)"


def country_code(value: Column | str) -> Column:
    """The two-letter code of a country; an unlisted spelling in upper case; null where absent."""
    spelling = F.upper(present(value))
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(CODES.items())])
    return F.coalesce(F.try_element_at(table, spelling), spelling)
