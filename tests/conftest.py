import datetime
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

import compare  # noqa: E402
from fundlake import schemas  # noqa: E402
from fundlake.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = compare.session()
    session.conf.set("spark.sql.maxMetadataStringLength", 10_000)  # else plans cut the paths of long temporary folders
    return session


@pytest.fixture(scope="session")
def sf_dir():
    folder = pathlib.Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test data")
    return str(folder)


def day(text):
    return datetime.date.fromisoformat(text)


@pytest.fixture
def book(spark):
    """A function from column dictionaries to the data model; unnamed tables are empty."""

    def build(**rows):
        def frame(name):
            schema = schemas.MODEL[name]
            given = rows.get(name, [])
            data = [tuple(row.get(f.name) for f in schema.fields) for row in given]
            return spark.createDataFrame(data, schema)

        return Tables(list(schemas.MODEL), frame)

    return build


@pytest.fixture
def small_book(book):
    """Two accounts (HUF and EUR), two priced funds and one without price, an account in two portfolios."""
    return book(
        currency=[{"id": 0, "iso_code": "HUF"}, {"id": 2, "iso_code": "EUR"}],
        account=[
            {"id": 1, "account_name": "home", "currency_id": 0, "date_open": day("2020-01-01")},
            {"id": 2, "account_name": "euro", "currency_id": 2, "date_open": day("2020-01-01")},
        ],
        fund=[{"id": i, "fund_name": f"fund {i}", "isin": f"HU{i}", "currency_id": 0,
               "inception_date": day("2020-01-01"), "description": "Source"} for i in (10, 11, 12)],
        fund_price=[
            {"fund_id": 10, "value_date": day("2020-01-02"), "price": 2.5},
            {"fund_id": 10, "value_date": day("2020-01-03"), "price": 3.5},
            {"fund_id": 10, "value_date": day("2021-01-04"), "price": 4.5},
            {"fund_id": 11, "value_date": day("2020-01-03"), "price": 1.005},
            {"fund_id": 11, "value_date": day("2020-01-06"), "price": 2.0},
        ],
        fund_investment_transaction=[
            {"id": 1, "value_date": day("2020-01-02"), "share_amount": 1.0, "account_id": 1, "fund_id": 10},
            {"id": 2, "value_date": day("2020-01-03"), "share_amount": 1.0, "account_id": 1, "fund_id": 10},
            {"id": 3, "value_date": day("2020-01-03"), "share_amount": 1.0, "account_id": 1, "fund_id": 10},
            {"id": 4, "value_date": day("2020-01-03"), "share_amount": 1.0, "account_id": 2, "fund_id": 11},
            {"id": 5, "value_date": day("2020-01-03"), "share_amount": 7.0, "account_id": 2, "fund_id": 12},
        ],
        rate=[{"id": 102, "rate_name": "EUR/HUF", "rate_type": "FX"},
              {"id": 201, "rate_name": "BASE", "rate_type": "interest"}],
        rate_fx=[{"id": 102, "from_currency_id": 2, "to_currency_id": 0}],
        rate_value=[{"rate_id": 102, "value_date": day("2020-01-06"), "value": 300.0}],
        portfolio=[{"id": 1, "name": "P1", "description": "a"}, {"id": 2, "name": "P2", "description": "b"},
                   {"id": 3, "name": "P3", "description": "empty", "last_valuation_date": day("2019-01-01")}],
        portfolio_x_account_rltnp=[
            {"portfolio_id": 1, "account_id": 1}, {"portfolio_id": 1, "account_id": 2},
            {"portfolio_id": 2, "account_id": 1},
        ],
    )
