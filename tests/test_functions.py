"""Rules, normal forms and small expressions against plain Python or stated values."""

import math
import re

import pytest
from pyspark.sql import functions as F

from terrasift.functions import names, rules
from terrasift.functions import scalar as S
from terrasift.operators import relational as R
from terrasift.operators import retrieval as V


def each(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_heaviest_category(spark):
    texts = ["THEFT FROM AUTO", "aggravated assault with a knife", "Burglary - theft", "public drunkeness", "MTR VEH THEFT", "B & E", "", None, "NaN", "picnic", "STALKING and ROBBERY", "shoplifting"]
    wanted = ["theft_larceny", "aggravated_assault", "burglary", "disorderly_quality_of_life", "motor_vehicle_theft", "burglary", "other", "other", "other", "other", "robbery", "theft_larceny"]
    assert each(spark, texts, lambda c: rules.heaviest(c)["key"]) == wanted

    def slow(text):
        hits = [(v[1], -i, k) for i, (k, v) in enumerate(rules.CATEGORIES.items()) if v[2] and re.search(v[2], (text or "").upper())]
        return max(hits)[2] if hits else "other"

    assert [slow(t) for t in texts] == wanted


def test_sales_at_market(spark):
    rows = [("3", "", "", 5.0), ("", "estate of x", "", 5e5), ("37", "", "", 5e5), ("", "", "CO", 5e5), ("", "SHERIFF DEED", "", 5e5), ("0", "VALID", "DE", 5e5), ("0", "VALID", "DE", 1.0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, p double").select(rules.at_market("a", "b", "c", "p").alias("t")).select("t.*")
    assert [r["is_arms_length"] for r in df.collect()] == [False, False, True, False, False, True, False, False]


def test_metro_names(spark):
    assert each(spark, ["Nashville-Davidson--Murfreesboro, TN Metro Area", " Cañon City, CO  Micro Area", "Mayagüez, PR"], names.metro) == ["nashville-davidson-murfreesboro, tn", "canon city, co", "mayaguez, pr"]
    assert each(spark, ["new york-newark-jersey city, ny-nj-pa", "salt lake city-murray, ut", "odd"], lambda c: F.concat_ws("/", names.first_city(c), names.first_state(c))) == ["new york/ny", "salt lake city/ut", "odd/"]
    odd = ["Metro Area", "A  Micro  area", "--St.  Paul---Park--, MN ", None, "", "Two, Commas, VA-NC METRO AREA", "No State, 12", "Area Metro"]
    assert each(spark, odd, names.metro) == ["metro area", "a", "st. paul-park-, mn", None, "", "two, commas, va-nc", "no state, 12", "area metro"]
    assert each(spark, ["two, commas, va-nc", "no state, 12", "", None, "x,ny"], lambda c: F.concat_ws("/", names.first_city(c), names.first_state(c))) == ["two, commas/va", "no state, 12/", "/", "", "x/ny"]


def test_addresses(spark):
    rows = ["4002 LORIGAN St.", "12B North Highland Avenue, #4", "Penn Way", None, "7"]
    assert each(spark, rows, names.address) == ["4002 lorigan st", "12b n highland av 4", "penn wy", "", "7"]
    assert each(spark, rows, lambda c: names.street_word(names.address(c))) == ["lorigan", "highland", "penn", "", ""]
    assert each(spark, rows, lambda c: names.house_number(names.address(c))) == ["4002", "12b", "", "", "7"]


def test_pads_and_numbers(spark):
    assert each(spark, ["1", "1234", None], lambda c: S.zero_pad(c, 3)) == ["001", "1234", None]
    assert each(spark, ["$1,200", " 7 ", "x", None], S.number) == [1200.0, 7.0, None, None]
    assert each(spark, ["nan", " None ", "a", ""], S.null_if_blank) == [None, None, "a", None]
    assert each(spark, ["paid $1,200.50 for three at -5%", "none"], S.numbers_in) == [[1200.5, -5.0, 3.0], []]
    assert each(spark, ["2024-02-03T00:00:00+05", "02/03/2024 01:00:00 PM", "x"], lambda c: F.to_date(S.first_date(c, "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy hh:mm:ss a")).cast("string")) == ["2024-02-03", "2024-02-03", None]
    assert each(spark, ["Pittsburgh, PA", "pittsburgh pa", "New York"], S.city_key) == ["pittsburgh", "pittsburgh", "new york"]


def test_distance_and_bearing(spark):
    df = spark.range(1).select(S.miles(F.lit(40.0), F.lit(-80.0), F.lit(41.0), F.lit(-80.0)), S.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), S.turn(F.lit(0.0), F.lit(90.0)), S.turn(F.lit(0.0), F.lit(330.0)), S.turn(F.lit(350.0), F.lit(5.0)))
    a, b, right, left, straight = df.first()
    assert a == pytest.approx(math.radians(1) * S.EARTH_MILES) and b == pytest.approx(90) and (right, left, straight) == ("right", "slight left", "straight")


@pytest.mark.parametrize("n", [1, 2, 7, 100])
@pytest.mark.parametrize("p", [10, 50, 90, 99, 100])
def test_floor_index_percentile(spark, n, p):
    values = sorted((i * 37) % 101 / 7 for i in range(n))
    found = R.floor_index_percentile(spark.createDataFrame([(v,) for v in values], "v double"), "v", p)
    assert found == values[math.floor(min(max(p, 50), 99) / 100 * (n - 1))]


def test_percentile_of_nothing(spark):
    assert R.floor_index_percentile(spark.createDataFrame([(None,)], "v double"), "v", 90) is None


def test_verdicts(spark):
    assert each(spark, ["1. Miami 2. Denver", "Denver, then Miami", "Miami", "", None], lambda c: V.verdict(c, ["miami", "denver"], ordered=True)) == ["PASS", "FAIL", "FAIL", "FAIL", "FAIL"]
    assert each(spark, ["about 55", "about 27.5 or 55"], lambda c: V.verdict_numbers(c, [55.0], 0.01, [27.5])) == ["PASS", "FAIL"]
    assert each(spark, ["1 2 3 4 5 6", "1 2"], lambda c: V.blocked(c, F.lit("1"))) == [True, False]


def test_history_keeps_the_newest(spark):
    df = spark.createDataFrame([(1, 0, "a" * 5), (1, 1, "b" * 50), (2, 0, None)], "k int, t int, x string")
    assert sorted((r["k"], r["t"]) for r in V.recent(df, "k", "t", "x", 10).collect()) == [(1, 1), (2, 0)]


def test_marks_of_all_latin_letters(spark):
    rows = [("Škoda Žižkov Łodź Māori", "Skoda Zizkov Łodz Maori"), ("Việt Nam ẞ", "Viet Nam ẞ"), ("e\u0301\u0327 ç", "e c"), (None, None)]
    from terrasift.functions import scalar

    found = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(scalar.without_marks("t").alias("t")).collect()
    assert [r["t"] for r in found] == [b for _, b in rows]
