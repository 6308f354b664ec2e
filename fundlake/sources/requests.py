"""Addresses to fetch, one per control row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Addresses of the public sources and how they write dates.
FX_URL = ("https://www.mnb.hu/en/arfolyam-tablazat?deviza=rbCurrencySelect&devizaSelected={iso_code}"
          "&datefrom={import_date}&datetill={today}&order=1")
INTEREST_URL = ("https://www.mnb.hu/en/Jegybanki_alapkamat_alakulasa?datefrom={import_date}"
                "&datetill={today}&order=0")
FUND_BY_ISIN_URL = "http://www.bamosz.hu/en/alapoldal?isin={isin}"
FUND_HISTORY_URL = "https://amfunds.credit-suisse.com/ch/en/retail/fund/history/{isin}?currency=CHF"
ISO_DATE = "yyyy-MM-dd"
SLASHED_DATE = "dd'%2F'MM'%2F'yyyy"


def plan_requests(control: DataFrame, template: str, today: str | Column,
                  date_format: str = ISO_DATE) -> DataFrame:
    """``control`` with a ``url`` column: ``template`` with the row's values for the names in braces.

    ``{today}`` is the given day. Dates are written in ``date_format``, other values are URL-encoded.
    """
    day = F.lit(today).cast("date") if isinstance(today, str) else today
    kinds = dict(control.dtypes)

    def value(name: str) -> Column:
        if name == "today":
            return F.date_format(day, date_format)
        if kinds[name] == "date":
            return F.date_format(F.col(name), date_format)
        return F.url_encode(F.col(name).cast("string"))

    pieces = re.split(r"\{(\w+)\}", template)
    columns = [value(text) if i % 2 else F.lit(text) for i, text in enumerate(pieces) if text]
    return control.withColumn("url", F.concat(*columns))
