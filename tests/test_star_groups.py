"""Star queries parse the groups of features that they read, and no others."""

import duckdb
import pytest
from pyspark.sql import functions as F

from listing_lake.operators import extract, star
from listing_lake.plans import bindings, q_export, q_star
from listing_lake.sources import scratch
from test_queries import norm

SF = "/root/testdata/sf0.001"


def test_a_dimension_parses_its_own_groups(spark):
    pages = bindings.listing_pages(spark, SF)
    whole = star.plain(extract.features(pages))
    assert star.plain(q_star.some_features(pages, ["condition", "price"])).schema == whole.schema
    whole = scratch.kept(whole)
    for table in star.DIMENSIONS:
        groups = sorted({"price", *star.GROUPS_OF.get(table, ())})
        some = scratch.kept(star.plain(q_star.some_features(pages, groups)))
        found, want = (star.dimension(star.with_costs(rows), table) for rows in (some, whole))
        assert found.count() == want.count() and not found.exceptAll(want).count(), table


def test_fields_of_other_groups_are_not_read(spark):
    pages = bindings.listing_pages(spark, SF)
    plan = star.plain(q_star.some_features(pages, ["condition", "price"]))._jdf.queryExecution().optimizedPlan().toString()
    parsed = [line for line in plan.splitlines() if "from_json" in line]
    assert parsed and not any("surfaceConstitution," in line.split("from_json", 1)[1].split("html", 1)[0] for line in parsed)


def test_all_groups_are_read_where_they_are_written(spark, monkeypatch):
    q_star.rows_of(spark, SF)
    monkeypatch.setattr(q_star, "some_features", None)
    assert q_star.rows_of(spark, SF, "dim_condition").where(F.col("has_rooms")).count() > 0


@pytest.mark.parametrize("name", ["e12_facts", "e13_new_facts", "e14_feature_bridge", "e15_surface_bridge", "e16_load_statistics", "e17_orphans", "e18_doubles", "e8_dim_building_info", "e8_dim_additional_costs", "e17_integrity"])
def test_equals_sql_with_own_groups(spark, monkeypatch, name):
    """Also where the tests before have written all groups."""
    made = scratch.made
    monkeypatch.setattr(scratch, "made", lambda session, what, source: what != "snapshots" and made(session, what, source))
    duck = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = q_star.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(q_star.SQL[name])
    theirs = [d[0] for d in found.description]
    want = sorted(tuple(norm(dict(zip(theirs, r, strict=True))[c]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == want


@pytest.fixture
def own_groups(monkeypatch):
    """As if no test before had written all groups."""
    made = scratch.made
    monkeypatch.setattr(scratch, "made", lambda session, what, source: what != "snapshots" and made(session, what, source))


def equals_sql(spark, module, name):
    duck = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = module.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(module.SQL[name])
    theirs = [d[0] for d in found.description]
    want = sorted(tuple(norm(dict(zip(theirs, r, strict=True))[c]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["g1_earliest_dates", "g2_wide", "g3_earliest_features", "g6_listing_counts", "g7_i11_volume_plan"])
def test_extracts_equal_sql_with_own_groups(spark, own_groups, monkeypatch, name):
    """None of them parses all groups."""
    features = extract.features
    monkeypatch.setattr(extract, "features", lambda pages, **x: features(pages, **x) if x else features(pages.limit(0)))
    equals_sql(spark, q_export, name)


@pytest.mark.parametrize("module, name", [(q_export, "g1_earliest_dates"), (q_export, "g6_listing_counts"), (q_export, "g7_i11_volume_plan"), (q_star, "e13_new_facts")])
def test_dates_and_types_need_no_pages(spark, own_groups, monkeypatch, module, name):
    monkeypatch.setattr(q_star, "some_features", None)
    monkeypatch.setattr(star, "plain", lambda rows, plain=star.plain: plain(rows.drop("html_source")))
    assert module.QUERIES[name](spark, SF).count()


def joins_of(df, kind="Join"):
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if kind in line]


def test_facts_are_not_broadcast(spark, own_groups):
    """Keys of compressed files look small, a table of Python's rows large: Spark would send facts through the driver."""
    joins = joins_of(q_star.QUERIES["e13_new_facts"](spark, SF))
    assert joins and not any("BroadcastHashJoin" in j and "LeftAnti" in j or "BuildLeft" in j for j in joins)
    first = joins_of(q_export.QUERIES["g3_earliest_features"](spark, SF), "LeftSemi")
    assert first and all("SortMergeJoin" in j for j in first)


@pytest.mark.parametrize("name, key", [("e14_feature_bridge", "feature_id"), ("e15_surface_bridge", "surface_composition_id")])
def test_bridges_are_counted_before_they_meet_names(spark, own_groups, name, key):
    plan = q_star.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Aggregate [{key}#" in plan and plan.index("Join Inner") < plan.index(f"Aggregate [{key}#")
