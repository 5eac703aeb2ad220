import pytest

from gridloom.sources import schema


def roles_of(spark, header, data, **options):
    names = schema.with_headers(header)
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(data)], ", ".join(["_row int", *[f"`{n}` string" for n in names]]))
    return schema.column_roles(df, "_row", **options)


@pytest.mark.parametrize(
    "name, values, role, confidence",
    [
        ("site_name", ["x"], "LOCATION_ID", 0.98),
        (" Ploygon ", ["x"], "GEO", 0.98),
        ("hardering", ["x" * 80], "META", 0.98),
        ("Base location", ["x"], "LOCATION_ID", 0.85),
        ("main-facility", ["x"], "LOCATION_ID", 0.85),
        ("building_name", ["x"], "LOCATION_ID", 0.85),  # its word `building` comes first
        ("component", ["x"], "COMPONENT_ID", 0.85),
        ("coordinate", ["x"], "GEO", 0.85),
        ("my coordinate", ["x" * 30], "UNKNOWN", 0.4),  # whole names only
        ("Projects used", ["x"], "DEPENDENCY", 0.85),
        ("Remarks_on_type", ["x"], "LOCATION_DESC", 0.85),
        ("סטטוס", ["x" * 99], "META", 0.85),
        ("מיקום", ["x"], "LOCATION_ID", 0.85),
        ("foo", ["x" * 61], "FREE_TEXT", 0.85),
        ("foo", ["x" * 19], "META", 0.85),
        ("foo", ["x" * 40], "UNKNOWN", 0.4),
        ("foo", [None], "UNKNOWN", 0.4),
    ],
)
def test_role_of_a_column(spark, name, values, role, confidence):
    r = roles_of(spark, ["site", name], [("a", v) for v in values]).filter("position = 1").first()
    assert (r.role, r.confidence) == (role, confidence)


def test_first_column_samples_and_sparse(spark):
    data = [("q" * 30, None if k % 3 else f"v{k}", f"w{k}") for k in range(40)]
    got = {r.column_name: r for r in roles_of(spark, ["foo", None, "bar"], data).collect()}
    assert (got["foo"].role, got["foo"].confidence) == ("LOCATION_ID", 0.6)
    assert got["col_1"].sparse and got["col_1"].samples == ["v0", "v3", "v6", "v9", "v12"] and not got["bar"].sparse
    assert got["bar"].samples == ["w0", "w1", "w2", "w3", "w4"]


def test_fallbacks_and_override(spark):
    data = [("s" * 10, "u" * 30, "v" * 40)]
    s = schema.schema_summary(roles_of(spark, ["kind", "foo", "bar"], data)).first()
    assert s.location_column == "kind" and s.dependency_columns == ["foo", "bar"] and len(s.warnings) == 2 and s.confidence == 0.4
    s = schema.schema_summary(roles_of(spark, ["kind", "foo", "bar"], data, overrides={"foo": "LOCATION_ID", "bar": "FREE_TEXT"})).first()
    assert s.location_column == "foo" and s.dependency_columns == ["bar"] and s.meta_columns == ["kind"] and s.warnings == [] and s.confidence == 0.85
    none = roles_of(spark, ["site", "notes"], [])
    assert {r.column_name: r.role for r in none.collect()} == {"site": "LOCATION_ID", "notes": "LOCATION_DESC"}


def test_sheets_stack_under_the_first_header(spark):
    a = spark.createDataFrame([("1", "2")], "x string, y string").toDF("x", "")
    b = spark.createDataFrame([(3, 4, 5)], "p int, q int, r int")
    assert [tuple(r) for r in schema.stacked([a, b]).collect()] == [("1", "2"), ("3", "4")]
    assert schema.stacked([a, b]).columns == ["x", "col_1"]
