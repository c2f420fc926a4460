"""Samples and first polygons test a number of targets that depends on how many are asked for, not on how many lie there."""

from pyspark.sql import functions as F

from phenogrid.functions import geo
from phenogrid.operators import sampling, spatial


def _counting(spark, monkeypatch, name):
    """Calls of a spatial test, counted row by row."""
    counter, test = spark.sparkContext.accumulator(0), getattr(geo, name)

    @F.udf("boolean")
    def seen(_):
        counter.add(1)
        return True

    def counted(*args):
        found = test(*args)
        # the counter sees a column of either side, as what it sees must not be known before they meet
        return F.when(seen(found.cast("string") if name == "distance_km" else F.concat(F.col(args[0]).cast("string"), F.size(args[2]).cast("string"))), found)

    monkeypatch.setattr(spatial, name, counted)
    return counter


def _cover(spark, n):
    return spark.range(n).selectExpr("id veg_id", "20.0D + (id * 37 % 1000) * 0.0002D vlat", "77.0D + (id * 91 % 1000) * 0.0002D vlon",
                                     "case when id % 7 = 0 then 50 else 10 end cover_class")


def _sites(spark):
    return spark.createDataFrame([(20.1, 77.1, "a"), (20.0, 77.0, "a"), (20.28, 77.1, "b"), (30.0, 77.0, "c")], "lat double, lon double, tile string")


def test_sample_measures_a_bounded_number_of_points(spark, monkeypatch):
    sites, cover, cap = _sites(spark), _cover(spark, 12_000), 24
    near = sites.crossJoin(cover.where("cover_class = 10")).withColumn("km", geo.distance_km("lat", "lon", "vlat", "vlon")).where("km <= 10")
    want: dict = {}
    for r in near.withColumn("h", F.xxhash64("veg_id", F.lit(1))).orderBy("h", "veg_id").collect():
        want.setdefault((r.lat, r.lon), []).append((r.veg_id, round(r.km, 9)))
    assert max(map(len, want.values())) > 5_000 and len(want) == 3
    measured = _counting(spark, monkeypatch, "distance_km")
    got: dict = {}
    for r in sampling.sampled_vegetation(sites, cover, cap).collect():
        got.setdefault((r.lat, r.lon), []).append((r.veg_id, round(r.km, 9)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v[:cap]) for k, v in want.items()}
    # before, every near point of every site
    assert measured.value < 2_500 < sum(map(len, want.values()))


def test_sample_goes_on_where_the_first_blocks_lie_outside(spark):
    # 500 points that are drawn first lie in the site's cubes but outside its circle
    order = spark.range(2_000).withColumn("h", F.xxhash64("id", F.lit(1))).orderBy("h", "id").collect()
    rows = [(r.id, 20.0 + (0.0905 if i < 500 else 0.0001 * (i % 700)), 77.0, 10) for i, r in enumerate(order)]
    cover = spark.createDataFrame(rows, "veg_id long, vlat double, vlon double, cover_class int")
    site = spark.createDataFrame([(20.0, 77.0, "a")], "lat double, lon double, tile string")
    got = {r.veg_id for r in sampling.sampled_vegetation(site, cover, 40).collect()}
    assert got == {r.id for r in order[500:540]}


def test_first_polygon_meets_a_bounded_number_of_polygons(spark, monkeypatch):
    box = "array(array({}))".format(", ".join(f"named_struct('lon', 77.0D + {x} + id * 1e-9D, 'lat', 20.0D + {y})" for x, y in (
        ("0.0D", "0.0D"), ("0.08D", "0.0D"), ("0.08D", "0.08D"), ("0.0D", "0.08D"), ("0.0D", "0.0D"))))
    villages = spark.range(3_000).selectExpr("id village_no", "concat('v', id) village", f"{box} rings")
    points = spark.range(40).selectExpr("id", "20.001D + id * 0.0001D lat", "77.001D + id * 0.0001D lon")
    tested = _counting(spark, monkeypatch, "in_rings")
    got = spatial.containing_polygon(points, villages, "village_no", ["village"]).collect()
    assert len(got) == 40 and {r.village for r in got} == {"v0"}
    # before, 3,000 for each point
    assert tested.value <= 40 * 8


def test_best_cells_of_a_village(spark):
    ring = lambda x, y, w: [[(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]]
    shapes = [(1, "one", ring(77.0, 20.0, 0.15)), (2, "two", ring(77.05, 20.05, 0.2)), (3, "none", ring(79.0, 20.0, 0.1))]
    villages = spark.createDataFrame(shapes, "village_no long, village string, rings array<array<struct<lon: double, lat: double>>>")
    cells = spark.range(4_000).selectExpr("id cell_id", "case when id % 3 = 0 then 'a' else 'b' end tile", "20.0D + (id * 37 % 1000) * 0.0003D clat",
                                          "77.0D + (id * 91 % 997) * 0.0003D clon", "(id * 13 % 50) / 50.0D fraction")
    sites = spark.createDataFrame([(20.01, 77.01, "a", 1), (20.2, 77.2, "b", 2), (25.0, 77.0, "a", None)],
                                  "lat double, lon double, tile string, village_no long")
    got = {(r.village_no, r.tile, r["rank"]): r.cell_id for r in sampling.best_of_villages(sites, sampling.eligible_cells(cells), villages, 12).collect()}
    want = {}
    for no, tile, x, w in ((1, "a", 77.0, 0.15), (2, "b", 77.05, 0.2)):
        y = x - 57.0
        inside = cells.where((F.col("tile") == tile) & (F.col("fraction") >= sampling.CELL_FRACTION)
                             & F.col("clon").between(x, x + w) & F.col("clat").between(y, y + w))
        for i, r in enumerate(inside.orderBy(F.col("fraction").desc(), "cell_id").limit(12).collect()):
            want[no, tile, i + 1] = r.cell_id
    assert got == want and len(got) == 24
