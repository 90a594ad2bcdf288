"""Files in drifting layouts, read into the tables' columns."""

import pytest
from pyspark.sql import functions as F

from terrasift.sources import census, folder, geocoding, incidents, lines, tabular
from terrasift.sources import property as P
from terrasift.sources.schema import SCHEMAS, empty


def written(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_headers_and_encodings(spark, tmp_path):
    raw = tabular.read_csv(spark, written(tmp_path / "a.csv", "﻿Crime Date.Time,LAT\n2024-01-01,1\n"))
    assert tabular.resolve(raw.columns, {"t": ("crimedatetime",), "y": ("Lat",), "z": ("zz",)}) == {"t": raw.columns[0], "y": "LAT"}
    assert tabular.named(raw, {"t": ("CrimeDateTime",), "z": ("zz",)}, ["z"]) is None
    raw = tabular.read_csv(spark, written(tmp_path / "b.csv", "name\nCañon\n", "latin-1"))
    assert raw.first()["name"] == "Cañon"


def test_listings(spark, tmp_path):
    text = "ADDRESS,CITY,ZIP,PRICE,SQUARE FEET,STATUS,LATITUDE,LONGITUDE,WALK SCORE,DAYS\n1 Main St,Boston,02101-1,\"$500,000\",1000,Active,42.1,-71.1,,7\n1 Main St,Boston,02101,490000,1000,Active,42.1,-71.1,80,9\n"
    raw = tabular.read_csv(spark, written(tmp_path / "x_2024-01-15.csv", text))
    rows = P.listings(raw, "x_2024-01-15.csv")
    r = P.latest(rows).collect()
    assert len(r) == 1 and r[0]["price"] == 500000 and r[0]["crime_city"] == "boston" and r[0]["snapshot_date"].isoformat() == "2024-01-15" and '"DAYS":"7"' in r[0]["raw_json"] and r[0]["price_per_sq_ft"] == 500
    assert P.snapshots(rows).count() == 2
    assert P.listings(tabular.read_csv(spark, written(tmp_path / "n.csv", "ADDRESS\nx\n")), "n.csv") is None
    assert P.date_in_name("favorites_20240115.csv") == "2024-01-15" and P.date_in_name("x_1999-01-01.csv") is None


def test_sales(spark, tmp_path):
    head = "PARID,PROPERTYHOUSENUM,PROPERTYADDRESSDIR,PROPERTYADDRESSSTREET,PROPERTYADDRESSSUF,PROPERTYUNITNO,PROPERTYCITY,PROPERTYSTATE,PROPERTYZIP,SALEDATE,RECORDDATE,PRICE,SALECODE,SALEDESC,INSTRTYP,MUNIDESC,SCHOOLDESC"
    text = f"{head}\np1,12,N,OAK,ST,4,PITTSBURGH,PA,15213,2024-01-02,,\"1,000,000\",0,VALID,DE,m,s\np2,,,,,,X,PA,1,2024-01-02,,1,3,LOVE,DE,m,s\n"
    r = P.sales(tabular.read_csv(spark, written(tmp_path / "s.csv", text)), "s.csv").collect()
    assert len(r) == 1 and r[0]["address"] == "12 N OAK ST #4" and r[0]["city"] == "Pittsburgh" and r[0]["is_arms_length"] and r[0]["county_fips"] == "42003" and r[0]["geocode_status"] == "pending" and list(r[0].asDict()) == list(SCHEMAS["sold_homes"])
    g = P.sales(tabular.read_csv(spark, written(tmp_path / "g.csv", "address,zip,sold_price,sold_date,lat,lon\n1 A St,15213,5,01/02/2024,40,-80\n")), "g.csv").first()
    assert g["geocode_status"] == "manual" and g["sold_date"].isoformat() == "2024-01-02"
    assert P.sales(tabular.read_csv(spark, written(tmp_path / "h.csv", "a,b\n1,2\n")), "h.csv") is None


@pytest.mark.parametrize("city", sorted(incidents.CITIES))
def test_incidents(spark, city):
    spec = incidents.CITIES[city]
    w, e, s, n = spec.box or (-90, -80, 40, 45)
    when = {"chicago": "01/02/2024 01:00:00 PM", "minneapolis": "2024/01/02 13:00:00+00", "indianapolis": "2024-01-02"}.get(city, "2024-01-02 13:00:00")
    own = {f: v[0] for f, v in spec.fields.items()}
    value = {"time": when, "hour": "13:00:00", "lat": str((s + n) / 2), "lon": str((w + e) / 2), "kind": "ROBBERY", "detail": "x", "place": "p"}
    rows = [[value.get(f, i) for f in own] for i in ("1", "1", "2")]
    rows.append([(value | {"lat": "0"}).get(f, "4") for f in own])
    if spec.box:
        rows.append([(value | {"lat": "10"}).get(f, "5") for f in own])
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in own.values()))
    found = incidents.combined(incidents.incidents(raw, city, "f.csv"), None).collect()
    assert len(found) == 2 and {r["category"] for r in found} == {"robbery"} and {r["year_month"] for r in found} == {"2024-01"} and found[0]["occurred_at"].hour == 13
    assert incidents.incidents(raw.drop(own["lat"]), city, "f.csv") is None


def test_unclassified(spark):
    df = empty(spark, "crime_incidents")
    assert incidents.unclassified(df)[0] == 0.0
    rows = spark.createDataFrame([("other", "a"), ("other", "a"), ("arson", "b")], "category string, raw_type string")
    share, top = incidents.unclassified(rows)
    assert share == pytest.approx(2 / 3) and top.first()["n"] == 2


def test_census(spark, tmp_path):
    raw = tabular.read_csv(spark, written(tmp_path / "t.csv", 'GEO_ID,NAME,P1_001N\nGeography,Name,Total\n1400000US42003140300,Tract,"4,200"\n'))
    r = census.tracts(raw).collect()
    assert [(x["tract_fips"], x["geo_id"], x["population"]) for x in r] == [("42003140300", "1400000US42003140300", 4200)]
    wide = tabular.read_csv(spark, written(tmp_path / "w.csv", 'Label (Grouping),"Aberdeen, SD Micro Area","Austin, TX Metro Area"\nTotal:,"42,287",7\nother,1,2\n'))
    assert {(x["name"], x["population"]) for x in census.metros(wide).collect()} == {("Aberdeen, SD Micro Area", 42287), ("Austin, TX Metro Area", 7)}
    long = tabular.read_csv(spark, written(tmp_path / "l.csv", "GEO_ID,NAME,P1_001N\n310M600US10100,Aberdeen,42\nx,y,z\n"))
    assert [(x["msa_code"], x["population"]) for x in census.metros(long).collect()] == [("10100", 42)]
    c = tabular.read_csv(spark, written(tmp_path / "c.csv", "CBSA Code,CBSA Title,FIPS State Code,FIPS County Code\n12420,Austin,48,453\n1010,A,1,3\nNote: x,,,\n"))
    assert {(x["cbsa_code"], x["state_fips"], x["county_fips"]) for x in census.counties(c).collect()} == {("12420", "48", "453"), ("01010", "01", "003")}


def test_hazards(spark):
    raw = spark.createDataFrame([("1001020100", "AL", "-9999", "5.5", "7", "12"), ("1001020100", "AL", "3", "5.5", "7", "12")], "GEOID string, stateabbrv string, RISK_SCORE string, IFLD_RISKS string, AVLN_RISK string, RISK_SPCTL string")
    r = census.hazards(raw).collect()
    assert len(r) == 1 and r[0]["tract_fips"] == "01001020100" and r[0]["county_fips"] == "01001" and r[0]["risk_score"] == 3 and r[0]["rfld_risks"] == 5.5 and r[0]["avln_risks"] == 7 and r[0]["risk_npctl"] == 12 and r[0]["tsun_risks"] is None


def test_geocoder_responses(spark):
    text = ['"1","a","Match","Exact","A","-80.1,40.2","9","L","42","3","1403","1"', '"2","a","Match","Non_Exact","A",-80.1,40.2,"9","L","42","003","140300","1"', '"3","a","No_Match"', "x"]
    rows = {r["row_id"]: r for r in geocoding.parsed(spark.createDataFrame([(t,) for t in text], "value string")).collect()}
    assert [rows[k]["tract_fips"] for k in "123"] == ["42003001403", "42003140300", None] and rows["1"]["lon"] == -80.1 and rows["2"]["lat"] == 40.2 and rows["3"]["geocode_accuracy"] == "No_Match" and len(rows) == 3


def test_geocoding_uses_the_cache_first(spark):
    sales = spark.createDataFrame([("1", "1 A St", None), ("2", "2 B St", None), ("3", "nowhere", None), ("4", "x", 9.0)], "sale_id string, full_address string, lat double").withColumns({c: F.lit(None).cast(t) for c, t in (("lon", "double"), ("tract_fips", "string"), ("geocode_source", "string"), ("geocode_accuracy", "string"))}).withColumn("geocode_status", F.lit("pending"))
    cache = spark.createDataFrame([("1 a st ", 1.0)], "full_address string, lat double").withColumn("address_key", geocoding.address_key("full_address")).withColumns({c: F.lit(None).cast(t) for c, t in SCHEMAS["geocode_cache"].items() if c not in ("full_address", "lat", "address_key")}).select(*SCHEMAS["geocode_cache"])
    rows, cache = geocoding.located(sales, cache, lambda pairs: [(k, 2.0, 3.0, "t", "Exact") for k, a in pairs if a == "2 B St"])
    assert {r["sale_id"]: (r["lat"], r["geocode_status"]) for r in rows.collect()} == {"1": (1.0, "success"), "2": (2.0, "success"), "3": (None, "pending"), "4": (9.0, "pending")}
    assert cache.count() == 2


def test_lines_and_features(spark):
    raw = spark.createDataFrame([([(0.0, 0.0), (1.0, 2.0)], "a"), ([(0.0, 0.0)], "b")], "points array<struct<x:double,y:double>>, name string")
    rows = lines.lines(raw, "pittsburgh", "Bike  Lanes", "f").collect()
    assert len(rows) == 1 and rows[0]["layer_type"] == "bike_lanes" and rows[0]["max_lat"] == 2.0 and '"name":"a"' in rows[0]["properties_json"]
    f = lines.point_features(spark.createDataFrame([(1.0, 2.0, "h", None), (None, 2.0, "i", None)], "lon double, lat double, id string, raw_json string")).collect()
    assert [r["feature"] for r in f] == ['{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{"id":"h"}}']
    j = tabular.json_rows(spark.createDataFrame([(float("nan"), None)], "a double, b string")).first()["value"]
    assert j == '{"a":null,"b":null}'


def test_shapefile(spark, tmp_path):
    import struct

    from terrasift.sources import shapefile

    def record(n, kind, parts):
        points = [p for part in parts for p in part]
        body = struct.pack("<i4d2i", kind, 0, 0, 1, 1, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *[sum(map(len, parts[:i])) for i in range(len(parts))]) + b"".join(struct.pack("<2d", *p) for p in points) if kind else struct.pack("<i", 0)
        return struct.pack(">2i", n, len(body) // 2) + body

    (tmp_path / "roads.shp").write_bytes(bytes(100) + record(1, 3, [[(0, 0), (1, 1)], [(2, 2), (3, 3), (4, 4)]]) + record(2, 0, []) + record(3, 5, [[(0, 0), (1, 0), (0, 0)]]))
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([4]) + bytes(15)
    (tmp_path / "roads.dbf").write_bytes(struct.pack("<4sIHH20x", b"\x03\x00\x00\x00", 3, 65, 5) + field + b"\r" + b" a   " + b" b   " + b"     ")
    rows = sorted((r["record"], len(r["points"]), r["properties"]["NAME"]) for r in shapefile.read(spark, str(tmp_path)).collect())
    assert rows == [(0, 2, "a"), (0, 3, "a"), (2, 3, None)]


def test_best_place(spark):
    df = spark.createDataFrame([("Park, Ohio", 0.9), ("Park, Pittsburgh", 0.2), ("Park, pittsburgh PA", 0.5)], "display_name string, importance double")
    assert geocoding.best_place(df, "Pittsburgh").first()["importance"] == 0.5


def test_folder_of_files_with_different_headers_and_encodings(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    written(tmp_path / "in" / "a.csv", "name,city\ncafé,Łódź\n")
    written(tmp_path / "in" / "deep" / "b.CSV", "name\ncafé\n", "latin-1")
    written(tmp_path / "in" / "c.csv", "city,name\nOslo,bar\n")
    written(tmp_path / "in" / "notes.txt", "not,read\n1,2\n")
    rows = {(r["name"], r["city"]) for r in tabular.read_csv(spark, str(tmp_path / "in")).collect()}
    assert rows == {("café", "Łódź"), ("café", None), ("bar", "Oslo")}


def test_first_write_keeps_the_first_in_order(spark, tmp_path):
    from pyspark.sql import functions as F

    from terrasift.operators.changes import TableStore

    store = TableStore(spark, str(tmp_path / "store"))
    new = spark.createDataFrame([(1, 5), (1, 9), (1, 7)], "id int, v int").repartition(3)
    for name, write in (("u", store.upsert), ("i", store.insert_ignore)):
        assert [tuple(r) for r in write(name, new, ["id"], [F.col("v").desc()]).collect()] == [(1, 9)]
    for v in range(4):
        assert store.upsert("u", spark.createDataFrame([(1, v)], "id int, v int"), ["id"]).first()["v"] == v
    assert len(list((tmp_path / "store" / "u").iterdir())) == 2


def bytes_read(spark, action):
    """(result, bytes that tasks read from files outside the library's own folder) by the status of the stages run."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    seen = lambda: (sc._jsc.sc().listenerBus().waitUntilEmpty(10_000), {(s.stageId(), s.attemptId()): s.inputBytes() for s in _stages(sc)})[1]
    before = seen()
    out = action()
    return out, sum(v for k, v in seen().items() if k not in before)


def _stages(sc):
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def test_folder_of_drifting_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub dir").mkdir(parents=True)
    written(root / "a.csv", "\ufeffNAME,City\ncafé,Łódź\n")
    written(root / "b+1.CSV", 'City,NAME\n"two\nlines",x\n,\n', "utf-8")
    written(root / "sub dir" / "c.csv", "NAME,City\ncafé,Orléans\nshort\n", "latin-1")
    written(root / "sub dir" / "d.csv", 'NAME,City\nplain,"a ""quoted"" one"\n')
    written(root / "e.csv", '"a\nheader",a,A,\n1,2,3,4,5\n')
    written(root / "notes.txt", "not,read\n1,2\n")
    (root / "empty.csv").write_bytes(b"")
    found = {(x.folder, tuple(x.header)): x for x in folder.layouts(spark, str(root))}
    assert set(found) == {("", ("NAME", "City")), ("", ("City", "NAME")), ("sub dir", ("NAME", "City")), ("", ("a\nheader", "a", "A_", "column 4", "column 5"))}
    sub = found["sub dir", ("NAME", "City")]
    assert sub.files == ["c.csv", "d.csv"] and {(r["NAME"], r["City"], r["source_file"]) for r in sub.rows.collect()} == {("café", "Orléans", "c.csv"), ("short", None, "c.csv"), ("plain", 'a "quoted" one', "d.csv")}
    assert [tuple(r)[:4] for r in found["", ("City", "NAME")].rows.collect()] == [("two\nlines", "x", "b+1.CSV", "")]
    assert [(r["NAME"], r["City"]) for r in found["", ("NAME", "City")].rows.collect()] == [("café", "Łódź")]
    rows, refused = folder.load_tree(spark, str(root), lambda x: tabular.named(x.rows, {"name": ("NAME",)}, ["name"], F.col("source_file")) if "NAME" in x.header else None)
    assert {(r["name"], r["source_file"]) for r in rows.collect()} == {("café", "a.csv"), ("x", "b+1.CSV"), ("café", "c.csv"), ("short", "c.csv"), ("plain", "d.csv")} and refused == ["e.csv"]
    with pytest.raises(ValueError):
        folder.layouts(spark, str(root), columns=3)


def test_every_byte_of_a_folder_is_read_once(spark, tmp_path):
    for i in range(12):
        written(tmp_path / f"f{i}.csv", f"NAME,x{i % 4}\n" + f"{'n' * 50},{i}\n" * 2000)
    size = sum(f.stat().st_size for f in tmp_path.glob("*.csv"))
    scans = []
    real = folder.stored
    folder.stored = lambda df: scans.append(bytes_read(spark, lambda: real(df))) or scans[-1][0]
    try:
        rows, refused = folder.load_tree(spark, str(tmp_path), lambda x: tabular.named(x.rows, {"name": ("NAME",)}, ["name"], F.col("source_file")))
        assert rows.count() == 24_000 and not refused
    finally:
        folder.stored = real
    plan = rows._jdf.queryExecution().toString()
    assert len(scans) == 2 and size <= scans[0][1] <= 1.1 * size and "csv" not in plan.lower().replace(".csv", "")


def test_folders_of_listings_sales_and_incidents(spark, tmp_path):
    for d in ("homes", "sold", "crime/pittsburgh", "crime/atlantis"):
        (tmp_path / d).mkdir(parents=True)
    written(tmp_path / "homes" / "x_2024-01-15.csv", "ADDRESS,CITY,ZIP,PRICE,LATITUDE,LONGITUDE\n1 A St,Pittsburgh,15213,100,40,-80\n")
    written(tmp_path / "homes" / "y_20240220.csv", "ADDRESS,CITY,ZIP,PRICE,LATITUDE,LONGITUDE\n1 A St,Pittsburgh,15213,90,40,-80\n")
    written(tmp_path / "homes" / "z.csv", "ADDRESS\nno place\n")
    rows, refused = folder.listings(spark, str(tmp_path / "homes"))
    found = {r["source_file"]: r for r in rows.collect()}
    assert {f: str(r["snapshot_date"]) for f, r in found.items()} == {"x_2024-01-15.csv": "2024-01-15", "y_20240220.csv": "2024-02-20"} and refused == ["z.csv"]
    assert P.latest(rows).first()["price"] == 90 and "source_f" not in found["x_2024-01-15.csv"]["raw_json"]
    written(tmp_path / "sold" / "g.csv", "address,zip,sold_price,sold_date,lat,lon\n1 A St,15213,5,01/02/2024,40,-80\n")
    written(tmp_path / "sold" / "h.csv", "address,zip,sold_price,sold_date,lat,lon\n1 A St,15213,7,01/02/2024,40,-80\n2 B St,15213,6,01/02/2024,40,-80\n")
    written(tmp_path / "sold" / "s.csv", "PARID,MUNIDESC,SCHOOLDESC,SALECODE,SALEDESC,INSTRTYP,PROPERTYHOUSENUM,PROPERTYADDRESSSTREET,PRICE,SALEDATE\np1,m,s,0,VALID,DE,12,OAK,1000,01/02/2024\n")
    rows, refused = folder.sales(spark, str(tmp_path / "sold"))
    assert {(r["address"], r["sold_price"], r["source_file"]) for r in rows.collect()} == {("1 A St", 7.0, "h.csv"), ("2 B St", 6.0, "h.csv"), ("12 OAK", 1000.0, "s.csv")} and not refused
    text = "INCIDENTTIME,Y,X,INCIDENTHIERARCHYDESC,PK\n2024-01-01 10:00:00,40.4,-80,THEFT,1\n"
    written(tmp_path / "crime/pittsburgh" / "a.csv", text)
    written(tmp_path / "crime/pittsburgh" / "b.csv", text)
    written(tmp_path / "crime/atlantis" / "c.csv", text)
    rows, refused = folder.incidents(spark, str(tmp_path / "crime"))
    assert [(r["city"], r["source_file"]) for r in rows.collect()] == [("pittsburgh", "a.csv")] and refused == ["atlantis/c.csv"]
