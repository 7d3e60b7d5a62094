import pytest

from factloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session(app_name="factloom-tests")
