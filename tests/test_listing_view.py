"""The listing view and its pages are derived in one job and never stored."""

from listing_lake.operators import pages
from listing_lake.plans import bindings

SF = "/root/testdata/sf0.001"


def test_pages_are_read_from_the_tables_alone(spark):
    files = bindings.listing_pages(spark, SF).inputFiles()
    assert files and all(f.removeprefix("file://").startswith(SF) for f in files)


def test_lines_move_twice(spark):
    plan = bindings.listings(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2


def test_large_methods_are_split_so_that_java_compiles_them(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(limit)
    bindings.listing_pages(spark, SF)
    assert spark.conf.get(limit) == "8000"
    spark.conf.set(limit, "20000")  # a session's own limit stays
    bindings.listing_pages(spark, SF)
    assert spark.conf.get(limit) == "20000"
    spark.conf.unset(limit)


def test_a_payload_ends_at_the_first_closing_tag(spark):
    script = '<script id="__NEXT_DATA__" type="application/json">'
    pages_ = {f"{script}a<b></scrip></SCRIPT>c</script>": "a<b></scrip>", f"{script}{'x<' * 50_000}": None, f"<script src='y'>z</script>{script}€</script>": "€", f"{script}</script>": None, "<SCRIPT\n ID = '__next_data__'>u</script>": "u"}
    rows = spark.createDataFrame(list(pages_.items()), "html string, want string")
    assert all(r.want == r.got for r in rows.select("want", pages.payload("html").alias("got")).collect())
