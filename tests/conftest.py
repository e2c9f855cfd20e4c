import pytest

from workbench.check import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples, floats rounded."""

    def collect(df, digits=6):
        def plain(value):
            if isinstance(value, float):
                return round(value, digits)
            if isinstance(value, list):
                return tuple(plain(v) for v in value)
            return value

        found = [tuple(plain(v) for v in row) for row in df.collect()]
        return sorted(found, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))

    return collect


@pytest.fixture
def plan():
    """Physical plan text."""
    return lambda df: df._jdf.queryExecution().executedPlan().toString()
