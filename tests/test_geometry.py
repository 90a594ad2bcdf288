"""Shapes as binary, the store of shapes and its fallbacks, projections against published places."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions import projection as J
from terrasift.operators.spatial import overlaps
from terrasift.sources import geometry as G


def square(x, y, size=1.0, hole=False):
    ring = [(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)]  # clockwise
    return ring[::-1] if hole else ring


SHAPES = [
    ("line", [[(0.0, 0.0), (1.5, -2.25)]]),
    ("line", [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 7.0)]]),
    ("polygon", [square(0.0, 0.0)]),
    ("polygon", [square(0.0, 0.0, 9.0), square(1.0, 1.0, hole=True), square(3.0, 3.0, hole=True), square(20.0, 0.0)]),
]


def test_binary_there_and_back(spark):
    rows = [(i, k, p) for i, (k, p) in enumerate(SHAPES)] + [(9, "polygon", None), (10, "line", []), (11, None, [[(1.0, 1.0), (2.0, 2.0)]])]
    df = spark.createDataFrame(rows, f"i int, kind string, parts {G.POINTS}").withColumn("wkb", G.encoded("kind", "parts"))
    found = {r["i"]: r for r in df.select("i", "wkb", G.decoded("wkb").alias("s")).collect()}
    for i, (kind, parts) in enumerate(SHAPES):
        assert found[i]["s"]["kind"] == kind and [[tuple(p) for p in part] for part in found[i]["s"]["parts"]] == parts
    assert all(found[i]["wkb"] is None and found[i]["s"]["kind"] is None for i in (9, 10, 11))
    assert struct.unpack_from("<BI", found[3]["wkb"]) == (1, 6) and struct.unpack_from("<BI", found[2]["wkb"]) == (1, 3)


def test_other_binaries(spark):
    big = struct.pack(">BII", 0, 2, 2) + np.array([1, 2, 3, 4], ">f8").tobytes()
    high = struct.pack("<BII", 1, 1002, 2) + np.array([1, 2, 9, 3, 4, 9], "<f8").tobytes()
    flagged = struct.pack("<BIII", 1, 2 | 0x80000000 | 0x20000000, 4326, 2) + np.array([1, 2, 9, 3, 4, 9], "<f8").tobytes()
    measured = struct.pack("<BII", 1, 3002, 2) + np.array([1, 2, 9, 8, 3, 4, 9, 8], "<f8").tobytes()
    for data in (big, high, flagged, measured):
        kind, parts = G.from_binary(data)
        assert kind == "line" and parts[0].tolist() == [[1, 2], [3, 4]]
    bad = [b"", b"\x01", struct.pack("<BI", 1, 1), big[:-1], struct.pack("<BII", 1, 5, 1) + struct.pack("<BII", 1, 3, 0)]
    for data in bad:
        with pytest.raises(G.Unreadable):
            G.from_binary(data)
    told = spark.createDataFrame([(bytearray(b),) for b in bad] + [(None,)], "b binary").select(G.decoded("b").alias("s")).collect()
    assert [r["s"]["kind"] for r in told] == [None] * 6 and all(r["s"]["error"] for r in told[:5]) and told[5]["s"]["error"] is None


@pytest.fixture(scope="module")
def tracts(spark):
    lon, lat = F.rand(1) * 50 - 120, F.rand(2) * 23 + 25
    rows = spark.range(20_000).select(F.format_string("%011d", "id").alias("tract_fips"), lon.alias("x"), lat.alias("y"))
    ring = F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in square(0.0, 0.0, 0.05)])
    made = rows.select("tract_fips", F.lit("polygon").alias("kind"), F.array(ring).alias("parts"))
    bad = spark.createDataFrame([("", "polygon", [square(0.0, 0.0)]), (None, "polygon", [square(0.0, 0.0)]), ("x", "polygon", None)], f"tract_fips string, kind string, parts {G.POINTS}")
    return made.unionByName(bad).repartition(4).cache()


def scanned(df):
    """Rows that the file scans of a frame's plan gave out."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        if name.startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_store_answers_windows_from_few_row_groups(spark, tracts, tmp_path):
    path = str(tmp_path / "store")
    G.write_store(tracts, path, "tract_fips", files=2)
    store = G.opened(spark, path, "tract_fips")
    assert store.data.count() == 20_000
    window = (-100.0, 30.0, -99.0, 31.0)
    found = store.window(*window)
    wanted = G.boxed(tracts.filter("tract_fips != '' and parts is not null")).filter(overlaps(*window))
    assert {r["tract_fips"]: r["parts"] for r in found.collect()} == {r["tract_fips"]: r["parts"] for r in wanted.collect()} and wanted.count() > 3
    assert 0 < scanned(store.data.filter(overlaps(*window)).select("tract_fips")) <= 5_000
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(min_lon)" in plan and "LessThanOrEqual(" in plan


def test_damaged_stores_fall_through(spark, tracts, tmp_path):
    few = tracts.limit(50).cache()
    good, cut, other, mixed = (str(tmp_path / n) for n in ("good", "cut", "other", "mixed"))
    for path in (good, cut, other, mixed):
        G.write_store(few, path, "tract_fips")
    for part in (tmp_path / "cut" / "data").glob("part-*"):
        part.write_bytes(part.read_bytes()[: part.stat().st_size // 2])
    for part in (tmp_path / "other" / "about").glob("part-*"):
        part.write_text(part.read_text().replace("EPSG:4326", "EPSG:3857"))
        (part.parent / f".{part.name}.crc").unlink()
    G.write_store(few.limit(49), str(tmp_path / "less"), "tract_fips")
    spark.read.parquet(str(tmp_path / "less" / "data")).write.mode("overwrite").parquet(f"{mixed}/data")
    for path in (str(tmp_path / "none"), cut, other, mixed):
        with pytest.raises(G.Unreadable):
            G.opened(spark, path, "tract_fips")
    with pytest.raises(G.Unreadable):
        G.opened(spark, good, "county")
    sources = [(n, lambda p=p: G.opened(spark, p, "tract_fips").shapes()) for n, p in (("cut", cut), ("other", other), ("mixed", mixed), ("good", good))]
    name, shapes, refused = G.first_readable(sources)
    assert name == "good" and shapes.count() == G.opened(spark, good, "tract_fips").data.count() and [r.split(":")[0] for r in refused] == ["cut", "other", "mixed"]
    with pytest.raises(G.Unreadable):
        G.first_readable(sources[:2])


def test_shapefile_records_as_tracts(spark):
    rows = [("f", 0, square(0.0, 0.0), {"GEOID10": "1001020100"}), ("f", 0, square(5.0, 0.0), {"GEOID10": "1001020100"}), ("f", 1, square(9.0, 9.0), {"NAME": "none"}), ("f", 2, square(2.0, 2.0), {"GEOID": "42003000100", "GEOID10": "1"})]
    records = spark.createDataFrame(rows, "file string, record int, points array<struct<x:double,y:double>>, properties map<string,string>")
    assert {r["tract_fips"]: len(r["parts"]) for r in G.tract_shapes(records).collect()} == {"01001020100": 2, "42003000100": 1}


def test_curve_keeps_neighbours_together(spark):
    df = spark.createDataFrame([(-180.0, -90.0), (179.999, 89.999), (500.0, 500.0), (0.0, 0.0), (-180.0, 0.0)], "x double, y double")
    assert [r[0] for r in df.select(G.along_curve(F.col("x"), F.col("y"))).collect()] == [0, 2**32 - 1, 2**32 - 1, 3 << 30, 2 << 30]


# projections

CLARKE = (6378206.4, 294.9786982)
#: Worked examples of a published manual: system, easting, northing, longitude, latitude.
PUBLISHED = [
    (J.System("lambert", CLARKE, values={"first": 33, "second": 45, "origin": 23, "middle": -96}), 1894410.9, 1564649.5, -75.0, 35.0),
    (J.System("albers", CLARKE, values={"first": 29.5, "second": 45.5, "origin": 23, "middle": -96}), 1885472.7, 1535925.0, -75.0, 35.0),
    (J.System("transverse_mercator", CLARKE, values={"middle": -75, "scale": 0.9996}), 127106.5, 4484124.4, -73.5, 40.5),
    (J.System("mercator", CLARKE, values={"middle": -180}), 11688673.7, 4139145.6, -75.0, 35.0),
]


def places(spark, system, rows):
    return [tuple(r["p"]) for r in spark.createDataFrame(rows, "x double, y double").coalesce(1).select(J.degrees(system, "x", "y").alias("p")).collect()]


def test_published_places(spark):
    for system, x, y, lon, lat in PUBLISHED:
        [(a, b)] = places(spark, system, [(x, y)])
        assert abs(a - lon) < 1e-6 and abs(b - lat) < 1e-6  # they are given to 0.1 m


def simpson(f, a, b, n=2000):
    h = (b - a) / n
    return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))


def test_inverse_of_forward_formulas(spark):
    """Along the middle meridian by integration, for cones by their defining formulas: 1e-9 degrees."""
    a, f = J.GRS80[0], 1 / J.GRS80[1]
    e = math.sqrt(f * (2 - f))
    utm = J.epsg(26917)
    rows = [(500_000.0, 0.9996 * simpson(lambda p: a * (1 - e * e) / (1 - (e * math.sin(p)) ** 2) ** 1.5, 0, math.radians(d))) for d in (1, 25, 40, 49, 80)]
    for (lon, lat), d in zip(places(spark, utm, rows), (1, 25, 40, 49, 80)):
        assert abs(lon + 81) < 1e-9 and abs(lat - d) < 1e-9
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    p1, p2, p0 = map(math.radians, (39.9333333333333, 40.9666666666667, 39.3333333333333))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    scale = a * m(p1) / (n * t(p1) ** n)
    wanted = [(-80.0, 40.44), (-77.75, 39.5), (-75.0, 41.9), (-85.3, 37.0)]
    rows = []
    for lon, lat in wanted:
        rho, angle = scale * t(math.radians(lat)) ** n, n * math.radians(lon + 77.75)
        rows.append((1968500.0 + rho * math.sin(angle) / J.SURVEY_FOOT, (scale * t(p0) ** n - rho * math.cos(angle)) / J.SURVEY_FOOT))
    feet = J.from_prj(PENNSYLVANIA)
    for got, place in zip(places(spark, feet, rows), wanted):
        assert max(abs(g - w) for g, w in zip(got, place)) < 1e-9
    assert places(spark, J.epsg(3857), [(-20037508.342789244, 0.0), (0.0, 20037508.342789244)]) == [pytest.approx((-180.0, 0.0)), pytest.approx((0.0, 85.0511287798066))]


PENNSYLVANIA = 'PROJCS["NAD_1983_StatePlane_Pennsylvania_South_FIPS_3702_Feet",GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",1968500.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-77.75],PARAMETER["Standard_Parallel_1",39.93333333333333],PARAMETER["Standard_Parallel_2",40.96666666666667],PARAMETER["Latitude_Of_Origin",39.33333333333334],UNIT["Foot_US",0.3048006096012192]]'


def test_systems_by_text_and_number():
    assert J.from_prj(PENNSYLVANIA).kind == "lambert" and J.from_prj(PENNSYLVANIA).unit == pytest.approx(J.SURVEY_FOOT)
    assert J.from_prj('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]').kind == "degrees"
    for text in (None, "", "PROJCS", PENNSYLVANIA.replace("Lambert_Conformal_Conic", "Krovak")):
        assert J.from_prj(text) is None
    assert [J.epsg(n).kind for n in (4326, 4269, 3857, 5070, 32617, 32733, 26918)] == ["degrees", "degrees", "mercator", "albers", *["transverse_mercator"] * 3] and J.epsg(2000) is None and J.epsg(32661) is None


def test_rows_without_a_known_system_are_rejected(spark):
    rows = [(1, "utm", [[(500000.0, 4427757.2)]]), (2, "degrees", [[(-80.0, 40.0)], []]), (3, "?", [[(1.0, 2.0)]]), (4, None, [[(1.0, 2.0)]]), (5, "degrees", [[(5000.0, 2.0)]]), (6, "none", [[(1.0, 2.0)]]), (7, "degrees", [[(None, 2.0)]]), (8, "degrees", None)]
    df = spark.createDataFrame(rows, f"id int, sys string, parts {G.POINTS}")
    good, rest = J.reprojected(df, "parts", "sys", {"utm": J.epsg(26917), "degrees": J.epsg(4326), "none": None})
    found = {r["id"]: r["parts"] for r in good.collect()}
    assert set(found) == {1, 2} and found[1][0][0]["x"] == pytest.approx(-81) and found[1][0][0]["y"] == pytest.approx(40.0, abs=1e-3)
    assert {r["id"]: r["parts"] for r in rest.collect()} == {r["id"]: r["parts"] for r in df.collect() if r["id"] > 2} and good.columns == rest.columns == df.columns
