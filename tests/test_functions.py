import random

from pyspark.sql import functions as F

from quillgrid.functions import hydrology, keys, lattice


def test_splitmix_wraps_like_unsigned_arithmetic(spark):
    random.seed(3)
    values = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *(random.randrange(-(1 << 63), 1 << 63) for _ in range(200))]
    df = spark.createDataFrame([(v,) for v in values], "z long").select("z", keys.splitmix64(F.col("z")).alias("k"))
    for r in df.collect():
        assert r.k == keys.signed(keys.splitmix64_int(r.z & keys.M64))


def test_known_values():
    # the first outputs of splitmix64 from state 0
    assert keys.splitmix64_int(0) == 0xE220A8397B1DCDAF
    assert keys.splitmix64_int(keys.GOLDEN) == 0x6E789E6AA1B965F4


def test_cell_ids(spark):
    rows = [(lod, i, j) for lod in (-6, 0, 15) for i in (-5, 0, 7) for j in (-9, 0, 3)]
    df = spark.createDataFrame(rows, "lod int, i int, j int").withColumn("id", lattice.cell_id(F.col("lod"), F.col("i"), F.col("j")))
    lod, i, j = lattice.decode_id(F.col("id"))
    assert sorted(tuple(r) for r in df.select(lod, i, j).collect()) == sorted(rows)
    assert [r[0] for r in spark.createDataFrame([(-1,), (-8,), (-9,), (7,)], "i int").select(lattice.parent(F.col("i"), 3)).collect()] == [-1, -1, -2, 0]


def test_longest_run_goes_round_the_year(spark):
    rows = [([True] * 12,), ([False] * 12,), ([True, True] + [False] * 8 + [True, True],), ([False, True, True, False] * 3,)]
    df = spark.createDataFrame(rows, "f array<boolean>").select(hydrology.longest_cyclic_run(F.col("f")))
    assert [r[0] for r in df.collect()] == [12, 0, 4, 2]
