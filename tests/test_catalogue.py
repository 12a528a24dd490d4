"""Every registered query that SQL can express gives what its SQL gives."""

import pytest
from conftest import DATA, plain

from arborlake.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, duck, name):
    out = catalogue.queries()[name](spark, f"{DATA}/sf0.001")
    columns, rows = duck(SQL[name], f"{DATA}/sf0.001")
    assert sorted(out.columns) == sorted(columns)
    assert plain(out.columns, out.collect()) == plain(columns, rows)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["percent_of_root", "export_html_rows"])
def test_all_depths(spark, duck, name):
    """Files are rows, too."""
    _, rows = duck(SQL[name], f"{DATA}/sf0.001")
    assert len(rows) == catalogue.queries()["tree_rollup"](spark, f"{DATA}/sf0.001").count()


def test_treemap_lays_out_files(spark):
    made = {(r.parent_path, r.full_path, r["rank"], r.size_bytes) for r in catalogue.queries()["treemap_layout"](spark, f"{DATA}/sf0.001").collect()}
    want = {(r.parent_path, r.full_path, r["rank"], r.size_bytes) for r in catalogue.queries()["treemap_candidates"](spark, f"{DATA}/sf0.001").collect()}
    assert made == want and any(p.count("/") == 4 for _, p, _, _ in made)
