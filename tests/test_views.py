"""The shop's views of events hold every event, whatever its kind."""

from pathlib import Path

import pytest

from marketloom.plans.driver_views import VIEWS, read_table, sql_views, view

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(n for n, (table, _, _) in VIEWS.items() if table == "events"))
def test_views_of_events_read_the_whole_table(spark, name):
    assert view(spark, str(DATA), name).count() == read_table(spark, str(DATA), "events").count()
    assert "WHERE" not in sql_views([name])
