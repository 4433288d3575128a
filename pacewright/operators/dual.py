"""Two-variable analysis: one row per point and sector with nine quantities, and density grids of pairs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pacewright.functions.geo import minetti_factor, speed_to_pace
from pacewright.operators.sector import SECTOR, fitness_readings, sector_speed_series

QUANTITIES = ["hr", "power", "cad", "temp", "grade", "ele", "speed", "pace", "gap"]
X_BINS, Y_BINS, LEAST_PAIRS = 96, 64, 10

# Which quantities may be drawn against each quantity.
PARTNERS = {
    "hr": ["speed", "pace", "gap", "power", "cad", "grade", "ele"],
    "power": ["speed", "pace", "gap", "cad", "hr", "temp", "grade", "ele"],
    "cad": ["speed", "pace", "gap", "hr", "power", "temp", "grade", "ele"],
    "temp": ["speed", "pace", "gap", "power", "cad", "ele"],
    "grade": ["power", "hr", "cad", "speed", "pace", "gap"],
    "ele": ["hr", "temp", "power", "cad"],
    "speed": ["hr", "power", "cad", "temp", "grade"],
    "pace": ["hr", "power", "cad", "temp", "grade"],
    "gap": ["hr", "power", "cad", "temp", "grade"],
}


def pair_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, y) for x, ys in PARTNERS.items() for y in ys], "x_name string, y_name string")


def pair_filter(pairs: DataFrame) -> DataFrame:
    """Pairs (x_name, y_name, ...) that may be analysed. The catalogue has 60 rows, so it is broadcast."""
    return pairs.join(F.broadcast(pair_catalogue(pairs.sparkSession)), ["x_name", "y_name"], "left_semi")


def sector_grade_windows(walk: DataFrame) -> DataFrame:
    """(track_id, sector_id, vseq, grade): the slope of each 50 m window at the point that closes it, and of a
    last one of 20 m or more at the sector's last point.

    One fold per sector over its ordered steps, inside the JVM; it collects (point, grade).
    """
    step = F.struct("step", "vseq", "d_ele", "seg_h", F.col("to_ele").alias("e"))
    whole = walk.groupBy(*SECTOR).agg(F.array_sort(F.collect_list(F.when(F.col("step") > 0, step))).alias("steps"), F.max(F.when(F.col("step") == 0, F.col("to_ele"))).alias("e0"))
    zero = "named_struct('acc', 0D, 'we', e0, 'out', cast(array() as array<struct<vseq:int,grade:double>>))"
    merge = """(s, x) -> if(x.d_ele is null, s, if(s.acc + x.seg_h >= 50,
        named_struct('acc', 0D, 'we', x.e, 'out', concat(s.out, array(named_struct('vseq', x.vseq, 'grade', (x.e - s.we) / (s.acc + x.seg_h))))),
        named_struct('acc', s.acc + x.seg_h, 'we', s.we, 'out', s.out)))"""
    last = "element_at(steps, -1)"
    finish = f"if(f.acc >= 20, concat(f.out, array(named_struct('vseq', {last}.vseq, 'grade', ({last}.e - f.we) / f.acc))), f.out)"
    d = whole.withColumn("f", F.expr(f"aggregate(steps, {zero}, {merge})"))
    rows = d.select(*SECTOR, F.posexplode(F.expr(finish)).alias("k", "g")).select(*SECTOR, "k", "g.vseq", "g.grade")
    return rows.groupBy(*SECTOR, "vseq").agg(F.max_by("grade", "k").alias("grade"))


def analysis_samples(walk: DataFrame) -> DataFrame:
    """One row per point of each sector with the nine quantities, null where there is none.

    All but the grades are windows over the sector's own rows, so they stay in one row from the walk on.
    """
    d = sector_speed_series(fitness_readings(walk), "v_temp", "v_ele", "hr", "cad", "power")
    effort = F.when((F.col("v_dd") > 0) & F.col("v_dz").isNotNull(), F.col("clean_speed") / minetti_factor(F.try_divide(F.col("v_dz"), F.col("v_dd"))))
    keys = [*SECTOR, "vseq"]
    d = d.select(*keys, F.col("v_temp").alias("temp"), F.col("v_ele").alias("ele"), "hr", "cad", "power", F.col("clean_speed").alias("speed"), speed_to_pace(effort).alias("gap"))
    d = d.join(sector_grade_windows(walk), keys, "left").withColumn("pace", speed_to_pace(F.col("speed")))
    return d.select(*keys, *QUANTITIES)


def metric_availability(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*SECTOR).agg(*[(F.count(c) > 0).alias(f"has_{c}") for c in QUANTITIES])


def extract_pair(samples: DataFrame, x: str, y: str) -> DataFrame:
    return samples.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*SECTOR, "vseq", F.col(x).alias("x"), F.col(y).alias("y"))


def sketched_ends(pairs: DataFrame, size: int = 8192) -> DataFrame:
    """(track_id, sector_id, n, x0, x1, y0, y1): the values at 0.2 % and 99.8 %, from quantile sketches.

    A sketch of each sector's values is made where they lie and merged, so no sector is sorted, however many pairs it
    has. At 8192 entries a value's rank is off by under 0.1 % of the pairs; up to as many pairs it is exact.
    """
    sketches = [F.kll_sketch_agg_double(c, F.lit(size)).alias(f"s_{c}") for c in ("x", "y")]
    d = pairs.groupBy(*SECTOR).agg(F.count("*").alias("n"), *sketches)
    at = lambda c, share: F.kll_sketch_get_quantile_double(F.col(f"s_{c}"), F.lit(share))
    return d.select(*SECTOR, "n", *[at(c, share).alias(f"{c}{k}") for c in ("x", "y") for k, share in ((0, 0.002), (1, 0.998))])


def robust_domain(pairs: DataFrame, sketched: bool = False) -> DataFrame:
    """(track_id, sector_id, x0, x1, y0, y1, n): the range without the outermost 0.2 % on either side, padded by 4 %.

    Exact by default, which sorts each sector twice; ``sketched`` takes the ends from quantile sketches.
    """
    return _padded(sketched_ends(pairs) if sketched else _sorted_ends(pairs))


def _sorted_ends(pairs: DataFrame) -> DataFrame:
    d = pairs
    w = Window.partitionBy(*SECTOR)
    d = d.withColumn("n", F.count("*").over(w))
    for c in ("x", "y"):
        d = d.withColumn(f"r_{c}", F.row_number().over(w.orderBy(c, "vseq")) - 1)
    low, high = F.floor(0.002 * (F.col("n") - 1)), F.ceil((1 - 0.002) * (F.col("n") - 1))
    return d.groupBy(*SECTOR).agg(F.max("n").alias("n"), *[F.max(F.when(F.col(f"r_{c}") == at, F.col(c))).alias(f"{c}{k}") for c in ("x", "y") for k, at in ((0, low), (1, high))])


def _padded(ends: DataFrame) -> DataFrame:
    for c in ("x", "y"):
        a, b = F.col(f"{c}0"), F.col(f"{c}1")
        pad = F.when(b - a > 0, (b - a) * 0.04).otherwise(F.greatest(F.abs(a) * 0.05, F.lit(0.5)))
        ends = ends.withColumn("_p", pad).withColumns({f"{c}1": F.when(b - a > 0, b).otherwise(a) + F.col("_p"), f"{c}0": a - F.col("_p")}).drop("_p")
    return ends


def density_2d(pairs: DataFrame, sketched: bool = False) -> DataFrame:
    """(track_id, sector_id, x_bin, y_bin, n) on a grid of 96 by 64; sectors with fewer than ten pairs have none."""
    d = pairs.join(robust_domain(pairs, sketched).filter(F.col("n") >= LEAST_PAIRS), list(SECTOR)).filter("x between x0 and x1 and y between y0 and y1")
    bin_of = lambda c, k: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * k), F.lit(k - 1)).cast("int")
    return d.groupBy(*SECTOR, bin_of("x", X_BINS).alias("x_bin"), bin_of("y", Y_BINS).alias("y_bin")).agg(F.count("*").alias("n"))


def relative_density(density: DataFrame) -> DataFrame:
    return density.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy(*SECTOR)))
