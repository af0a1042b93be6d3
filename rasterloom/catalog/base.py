"""Query registry, rounding helpers and the tables the queries run on.

No imagery comes with the test data, so its tables are read as rasters by
fixed integer rules. Each binding exists twice: as a DataFrame and as the
SQL common table expression of the same name used by the checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.operators import scenes as sc
from rasterloom.session import checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

YEARS = [1996, 1997, 1998, 1999, 2000, 2001]
WIDTH = 100
# A north-up 10 m grid; the second sensor has 30 m cells on the same origin.
AFFINE = (10.0, 0.0, 600000.0, 0.0, -10.0, 1200000.0)
CENTER = (600500.0, 1199250.0)
# area of interest with a slanted edge and a hole
AOI = [
    [(600100.0, 1199900.0), (600900.0, 1199700.0), (600850.0, 1198300.0), (600150.0, 1198500.0)],
    [(600300.0, 1199500.0), (600500.0, 1199500.0), (600500.0, 1199300.0), (600300.0, 1199300.0)],
]


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = (), recursive: bool = False):
    """Register a query, and its check if one can be written in SQL."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql, needs, recursive)
        return fn
    return register


def rd(col, digits: int = 6):
    """Rounded value without negative zero."""
    r = F.round(col, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def rq(expr: str, digits: int = 6) -> str:
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0 ELSE round({expr}, {digits}) END"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rd(F.col(c), digits) for c in cols})


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# --------------------------------------------------------------- bindings

def obs(spark, d) -> DataFrame:
    """Sentinel-like observations from lineitem."""
    c = F.col
    return read(spark, d, "lineitem").select(
        F.floor(c("l_orderkey") / WIDTH).cast("int").alias("row"),
        (c("l_orderkey") % WIDTH).cast("int").alias("col"),
        c("l_shipdate").alias("ts"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("scene_id"),
        c("l_linenumber").alias("scl"),
        F.round(c("l_quantity") * 200).cast("int").alias("B2"),
        F.round(c("l_extendedprice") / 10).cast("int").alias("B3"),
        F.round(c("l_discount") * 100000).cast("int").alias("B4"),
        F.round(c("l_tax") * 125000).cast("int").alias("B8"),
        ((c("l_partkey") * 37) % 10001).cast("int").alias("B11"),
        ((c("l_suppkey") * 91) % 10001).cast("int").alias("B12"),
    )


def scenes(spark, d) -> DataFrame:
    """Scene catalogue: one scene per ship date."""
    c = F.col
    return read(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyyMMdd").alias("scene_id")).agg(
        F.min("l_shipdate").alias("ts"),
        (F.sum("l_partkey") % 101).cast("double").alias("cloud_pct"),
        (F.min("l_suppkey") * 10.0).alias("xmin"),
        (600.0 + F.max("l_suppkey") * 5.0).alias("xmax"),
        F.lit(0.0).alias("ymin"),
        (F.sum("l_quantity")).cast("double").alias("ymax"),
    )


def observations(spark, d) -> DataFrame:
    return sc.select_observations(obs(spark, d), scenes(spark, d), YEARS)


def composite(spark, d) -> DataFrame:
    return sc.build_composite(obs(spark, d), scenes(spark, d), YEARS)


def composite_table(spark, d) -> DataFrame:
    """The composite, materialised once for operators that scan it several
    times (a written Parquet table in production)."""
    return checkpoint(composite(spark, d))


def pixels(spark, d) -> DataFrame:
    """Raw yearly scene: the full grid of orders left-joined with the median
    digital numbers of each calendar year; no observation means missing."""
    c = F.col
    grid = read(spark, d, "orders").select(
        F.floor(c("o_orderkey") / WIDTH).cast("int").alias("row"), (c("o_orderkey") % WIDTH).cast("int").alias("col"),
        F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year"),
    )
    o = sc.mask_clouds(obs(spark, d)).withColumn("year", F.year("ts")).where(c("year").isin(YEARS))
    med = sc.median_composite(o, scale=False).drop("n_obs")
    return grid.join(med, ["year", "row", "col"], "left")


def grid(spark, d) -> DataFrame:
    """Dense single-band integer raster from orders."""
    c = F.col
    return read(spark, d, "orders").select(
        F.floor(c("o_orderkey") / WIDTH).cast("int").alias("row"),
        (c("o_orderkey") % WIDTH).cast("int").alias("col"),
        F.floor(c("o_totalprice") / 10).cast("int").alias("v"),
        (c("o_custkey") % 331 != 0).alias("valid"),
    )


def classes(spark, d, date: int = 1) -> DataFrame:
    """Class maps of two dates from events."""
    c = F.col
    value = c("value") if date == 1 else c("value") * 7
    return read(spark, d, "events").select(
        F.floor(c("event_id") / WIDTH).cast("int").alias("row"), (c("event_id") % WIDTH).cast("int").alias("col"),
        (F.floor(value).cast("int") % 4).alias("class"),
    )


def classified(spark, d) -> DataFrame:
    """Both dates as one yearly class table."""
    a = classes(spark, d, 1).withColumn("year", F.lit(2022))
    return a.unionByName(classes(spark, d, 2).withColumn("year", F.lit(2024)))


def labelled(spark, d, table: DataFrame | None = None) -> DataFrame:
    """Composite of 1998..2000 with the fixture class rule; `table` is a
    composite already made."""
    c = F.col
    rule = F.when(c("NDWI") > 0, 0).when(c("NDBI") > 0, 3).when(c("NDVI") > 0.3, 1).otherwise(2)
    pixels = composite(spark, d) if table is None else table
    return pixels.dropna(subset=cfg.INDICES).withColumn("class", rule)


def landsat(spark, d) -> DataFrame:
    """Second sensor from events: 30 m cells, QA bits, two bands."""
    c = F.col
    return read(spark, d, "events").select(
        F.floor(c("event_id") / 34).cast("int").alias("row"), (c("event_id") % 34).cast("int").alias("col"),
        (1996 + c("user_id") % 3).cast("int").alias("year"),
        (c("user_id") % 64).cast("int").alias("qa_pixel"),
        F.floor(7000 + c("value") * 60).cast("int").alias("sr_b5"),
        (8000 + (c("event_id") * 7919) % 20000).cast("int").alias("sr_b6"),
    )


def landcover(spark, d) -> DataFrame:
    """Label raster with global land-cover codes, from orders."""
    c = F.col
    codes = F.array(*[F.lit(x) for x in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 0)])
    return read(spark, d, "orders").select(
        F.floor(c("o_orderkey") / WIDTH).cast("int").alias("row"), (c("o_orderkey") % WIDTH).cast("int").alias("col"),
        F.element_at(codes, (c("o_custkey") % 12 + 1).cast("int")).alias("wc"),
    )


def points(spark, d) -> DataFrame:
    """Labelled points from customer, some outside the raster."""
    c = F.col
    return read(spark, d, "customer").select(
        c("c_custkey").alias("point_id"),
        (600000.0 + (c("c_custkey") * 37 % 1050)).alias("x"),
        (1200000.0 - (c("c_custkey") * 53 % 1600)).alias("y"),
        (c("c_nationkey") % 4).alias("class"),
    )


def segments(spark, d) -> DataFrame:
    """Line features from customer: short roads with names and classes."""
    c = F.col
    kinds = F.array(*[F.lit(x) for x in ("motorway", "trunk", "primary", "secondary", "residential")])
    key = c("c_custkey")
    return read(spark, d, "customer").select(
        key.alias("fid"),
        F.when(key % 7 == 0, F.lit(None)).otherwise(c("c_mktsegment")).alias("name"),
        F.element_at(kinds, (c("c_nationkey") % 5 + 1).cast("int")).alias("highway"),
        (600000.0 + key * 37 % 1000).alias("x1"), (1200000.0 - key * 53 % 1600).alias("y1"),
        (600000.0 + (key * 37 + key % 13 * 20 - 110) % 1000).alias("x2"),
        (1200000.0 - (key * 53 + key % 11 * 20 - 90) % 1600).alias("y2"),
    )


_Y = ", ".join(map(str, YEARS))
_SEASON = " ".join(
    f"WHEN ts >= TIMESTAMP '{y - 1}-12-01' AND ts < TIMESTAMP '{y}-04-30' THEN {y}" for y in YEARS
)

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": ((), f"""
        SELECT CAST(floor(l_orderkey / {WIDTH}) AS INT) AS "row", CAST(l_orderkey % {WIDTH} AS INT) AS col,
               l_shipdate AS ts, strftime(l_shipdate, '%Y%m%d') AS scene_id, l_linenumber AS scl,
               CAST(round(l_quantity * 200) AS INT) AS B2, CAST(round(l_extendedprice / 10) AS INT) AS B3,
               CAST(round(l_discount * 100000) AS INT) AS B4, CAST(round(l_tax * 125000) AS INT) AS B8,
               CAST((l_partkey * 37) % 10001 AS INT) AS B11, CAST((l_suppkey * 91) % 10001 AS INT) AS B12
        FROM lineitem"""),
    "scenes": ((), """
        SELECT strftime(l_shipdate, '%Y%m%d') AS scene_id, min(l_shipdate) AS ts,
               CAST(CAST(sum(l_partkey) AS BIGINT) % 101 AS DOUBLE) AS cloud_pct,
               min(l_suppkey) * 10.0::DOUBLE AS xmin, 600.0::DOUBLE + max(l_suppkey) * 5.0::DOUBLE AS xmax,
               0.0::DOUBLE AS ymin, CAST(sum(l_quantity) AS DOUBLE) AS ymax
        FROM lineitem GROUP BY 1"""),
    "picked": (("scenes",), f"""
        SELECT *, CASE {_SEASON} END AS "year" FROM scenes WHERE cloud_pct < 60 AND (CASE {_SEASON} END) IS NOT NULL"""),
    "observations": (("obs", "picked"), """
        SELECT o.*, p."year" FROM obs o JOIN picked p ON o.scene_id = p.scene_id"""),
    "composite": (("observations",), """
        SELECT *, (B8 - B4) / nullif(B8 + B4, 0) AS NDVI, (B11 - B8) / nullif(B11 + B8, 0) AS NDBI,
               (B3 - B8) / nullif(B3 + B8, 0) AS NDWI
        FROM (SELECT "year", "row", col, median(B2) / 10000.0::DOUBLE AS B2, median(B3) / 10000.0::DOUBLE AS B3,
                     median(B4) / 10000.0::DOUBLE AS B4, median(B8) / 10000.0::DOUBLE AS B8,
                     median(B11) / 10000.0::DOUBLE AS B11, median(B12) / 10000.0::DOUBLE AS B12, count(*) AS n_obs
              FROM observations WHERE scl NOT IN (3, 8, 9, 10) GROUP BY 1, 2, 3)"""),
    "pixels": (("obs",), f"""
        SELECT g."year", g."row", g.col, m.B2, m.B3, m.B4, m.B8, m.B11, m.B12
        FROM (SELECT y."year", CAST(floor(o_orderkey / {WIDTH}) AS INT) AS "row", CAST(o_orderkey % {WIDTH} AS INT) AS col
              FROM orders, (SELECT unnest([{', '.join(map(str, YEARS))}]) AS "year") y) g
        LEFT JOIN (SELECT CAST(year(ts) AS INT) AS "year", "row", col, median(B2) AS B2, median(B3) AS B3, median(B4) AS B4,
                          median(B8) AS B8, median(B11) AS B11, median(B12) AS B12
                   FROM obs WHERE scl NOT IN (3, 8, 9, 10) GROUP BY 1, 2, 3) m
        ON g."year" = m."year" AND g."row" = m."row" AND g.col = m.col"""),
    "grid": ((), f"""
        SELECT CAST(floor(o_orderkey / {WIDTH}) AS INT) AS "row", CAST(o_orderkey % {WIDTH} AS INT) AS col,
               CAST(floor(o_totalprice / 10) AS INT) AS v, (o_custkey % 331 <> 0) AS valid FROM orders"""),
    "classes1": ((), f"""
        SELECT CAST(floor(event_id / {WIDTH}) AS INT) AS "row", CAST(event_id % {WIDTH} AS INT) AS col,
               CAST(floor(value) AS INT) % 4 AS class FROM events"""),
    "classes2": ((), f"""
        SELECT CAST(floor(event_id / {WIDTH}) AS INT) AS "row", CAST(event_id % {WIDTH} AS INT) AS col,
               CAST(floor(value * 7) AS INT) % 4 AS class FROM events"""),
    "classified": (("classes1", "classes2"), """
        SELECT "row", col, class, 2022 AS "year" FROM classes1 UNION ALL SELECT "row", col, class, 2024 FROM classes2"""),
    "labelled": (("composite",), """
        SELECT *, CASE WHEN NDWI > 0 THEN 0 WHEN NDBI > 0 THEN 3 WHEN NDVI > 0.3 THEN 1 ELSE 2 END AS class
        FROM composite WHERE NDVI IS NOT NULL AND NDBI IS NOT NULL AND NDWI IS NOT NULL"""),
    "landsat": ((), """
        SELECT CAST(floor(event_id / 34) AS INT) AS "row", CAST(event_id % 34 AS INT) AS col,
               CAST(1996 + user_id % 3 AS INT) AS "year", CAST(user_id % 64 AS INT) AS qa_pixel,
               CAST(floor(7000 + value * 60) AS INT) AS sr_b5, CAST(8000 + (event_id * 7919) % 20000 AS INT) AS sr_b6
        FROM events"""),
    "landcover": ((), f"""
        SELECT CAST(floor(o_orderkey / {WIDTH}) AS INT) AS "row", CAST(o_orderkey % {WIDTH} AS INT) AS col,
               [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 0][CAST(o_custkey % 12 + 1 AS INT)] AS wc FROM orders"""),
    "points": ((), """
        SELECT c_custkey AS point_id, 600000.0::DOUBLE + (c_custkey * 37 % 1050) AS x,
               1200000.0::DOUBLE - (c_custkey * 53 % 1600) AS y, c_nationkey % 4 AS class FROM customer"""),
    "segments": ((), """
        SELECT c_custkey AS fid, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS name,
               ['motorway', 'trunk', 'primary', 'secondary', 'residential'][CAST(c_nationkey % 5 + 1 AS INT)] AS highway,
               600000.0::DOUBLE + c_custkey * 37 % 1000 AS x1, 1200000.0::DOUBLE - c_custkey * 53 % 1600 AS y1,
               600000.0::DOUBLE + (c_custkey * 37 + c_custkey % 13 * 20 - 110) % 1000 AS x2,
               1200000.0::DOUBLE - (c_custkey * 53 + c_custkey % 11 * 20 - 90) % 1600 AS y2 FROM customer"""),
}


def with_tables(sql: str, needs: tuple[str, ...], recursive: bool = False) -> str:
    """Prefix a SELECT with the tables it needs, dependencies first. A SQL
    text that starts with a comma continues the table list itself."""
    ordered: list[str] = []

    def add(name: str):
        for dep in TABLES[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    parts = [f"{n} AS ({TABLES[n][1].strip()})" for n in ordered]
    body = sql.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not parts:
        return (head + body.lstrip(",").strip()) if body.startswith(",") else body
    return head + ",\n".join(parts) + "\n" + body
