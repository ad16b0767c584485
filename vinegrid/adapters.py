"""Pixel, scene and weather tables as views of the driver's tables. The SQL is the same for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Adapter -> (driver table, SQL).
ADAPTERS = {
    "px_s2": ("lineitem", """
        select cast(l_orderkey % 97 as int) as scene_id, cast(l_partkey % 64 as int) as row, cast(l_suppkey % 64 as int) as col,
          max(cast(300 + (l_orderkey*3 + l_linenumber*71) % 1500 as double)) as b2,
          max(cast(400 + (l_orderkey*5 + l_linenumber*89) % 2000 as double)) as b3,
          max(cast(500 + (l_orderkey*7 + l_linenumber*131) % 3000 as double)) as b4,
          max(cast(900 + (l_partkey*11 + l_linenumber*41) % 3000 as double)) as b5,
          max(cast(1100 + (l_partkey*19 + l_linenumber*43) % 3500 as double)) as b6,
          max(cast(1300 + (l_partkey*23 + l_linenumber*47) % 3800 as double)) as b7,
          max(cast(1500 + (l_partkey*13 + l_linenumber*17) % 4000 as double)) as b8,
          max(cast(700 + (l_suppkey*29 + l_linenumber*53) % 2500 as double)) as b11,
          max(cast(case when ((l_orderkey % 97)*31 + (l_partkey % 64)*17 + (l_suppkey % 64)*7) % 53 = 0 then 9 else 4 + ((l_orderkey % 97)*5 + (l_partkey % 64)*3 + (l_suppkey % 64)*1) % 3 end as int)) as scl
        from lineitem group by 1,2,3"""),
    "px_cs": ("lineitem", """
        select cast(l_orderkey % 97 as int) as scene_id, cast(l_partkey % 64 as int) as row, cast(l_suppkey % 64 as int) as col,
          max(1 - cast(((l_orderkey % 97)*37 + (l_partkey % 64)*11 + (l_suppkey % 64)*23) % 60 as double)*cast(0.0068 as double)) as cs,
          max(1 - cast(((l_orderkey % 97)*41 + (l_partkey % 64)*19 + (l_suppkey % 64)*29) % 60 as double)*cast(0.0051 as double)) as cs_cdf
        from lineitem where l_linenumber <> 7 group by 1,2,3"""),
    "px_cld": ("lineitem", """
        select cast(l_orderkey % 97 as int) as scene_id, cast(l_partkey % 64 as int) as row, cast(l_suppkey % 64 as int) as col,
          max(cast(((l_orderkey % 97)*43 + (l_partkey % 64)*7 + (l_suppkey % 64)*13) % 60 as double)*cast(0.51 as double)) as probability
        from lineitem where l_linenumber <> 6 group by 1,2,3"""),
    "px_s1": ("lineitem", """
        select cast(l_orderkey % 61 as int) as scene_id, cast(l_partkey % 64 as int) as row, cast(l_suppkey % 64 as int) as col,
          max(-25 + cast((l_orderkey*13) % 1500 as double)/100) as vh,
          max(-18 + cast((l_partkey*7) % 1500 as double)/100) as vv
        from lineitem group by 1,2,3"""),
    "px_landsat": ("lineitem", """
        select cast(l_orderkey % 53 as int) as scene_id, cast(l_partkey % 22 as int) as row, cast(l_suppkey % 22 as int) as col,
          max(cast(40000 + (l_orderkey*11) % 9000 as int)) as st_b10,
          max(cast((l_orderkey*l_linenumber) % 64 as int)) as qa_pixel
        from lineitem group by 1,2,3"""),
    "px_eco": ("lineitem", """
        select cast(l_orderkey % 41 as int) as scene_id, cast(l_partkey % 10 as int) as row, cast(l_suppkey % 10 as int) as col,
          max(cast(14000 + (l_orderkey*11) % 1500 as int)) as lst
        from lineitem group by 1,2,3"""),
    "era5_hourly": ("events", """
        select user_id % 16 as cell_id, date_trunc('hour', ts) + interval 150 days as ts,
          max(cast(273.15 as double) + value % 40) as temperature_2m,
          max(cast(268.15 as double) + value % 20) as dewpoint_temperature_2m,
          max(value % 7)/1000 as total_precipitation_hourly, -max(value % 5)/1000 as potential_evaporation, -max(value % 3)/1000 as evaporation_from_vegetation_transpiration,
          max(value*1000) - 50000 as surface_net_solar_radiation,
          max(value % 9) - 4 as u_component_of_wind_10m,
          max(value % 11) - 5 as v_component_of_wind_10m
        from events group by 1,2"""),
    "dem": ("lineitem", """
        select cast(l_partkey % 64 as int) as row, cast(l_suppkey % 64 as int) as col,
          max(l_extendedprice)/100 as elevation
        from lineitem group by 1,2"""),
    "flowacc": ("lineitem", """
        select cast(l_partkey % 4 as int) as row, cast(l_suppkey % 4 as int) as col, cast(count(*) as double) as b1
        from lineitem group by 1,2"""),
    "scenes": ("orders", """
        select o_orderkey as scene_id, o_orderdate as acquired_at, case when o_orderkey % 5 = 0 then 'S1' when o_orderkey % 5 = 1 then 'S2' when o_orderkey % 5 = 2 then 'L8' when o_orderkey % 5 = 3 then 'L9' else 'ECO' end as sensor,
          cast((o_orderkey * 37) % 1000 as double) / 10 as cloud_pct, split(case when o_orderkey % 3 = 0 then 'VV' else 'VV,VH' end, ',') as polarisations,
          case when o_orderkey % 4 = 0 then 'EW' else 'IW' end as instrument_mode, case when o_orderkey % 2 = 0 then 'ASCENDING' else 'DESCENDING' end as orbit_pass,
          cast(o_custkey % 64 as double) * 10 as min_x, cast(o_custkey % 64 as double) * 10 + 200 as max_x, cast(o_custkey % 61 as double) * 10 as min_y, cast(o_custkey % 61 as double) * 10 + 200 as max_y
        from orders"""),
    "scene_sun": ("orders", """
        select o_orderkey as scene_id, 110 + cast((o_orderkey * 13) % 700 as double) / 10 as azimuth,
          case when o_orderkey % 11 <> 0 then cast(o_custkey % 30 as double) / 10 end as zenith
        from orders"""),
    "parcel_edges": ("supplier", """
        with p as (
          select s_suppkey as parcel_id, cast(s_suppkey % 53 as double) * 10 + 3 as x0, cast(s_suppkey % 47 as double) * 10 + 2 as y0,
            cast(30 + (s_suppkey * 7) % 50 as double) as w, cast(30 + (s_suppkey * 11) % 50 as double) as h, cast(s_suppkey % 9 as double) as d
          from supplier
        )
        select parcel_id, 0 as edge_id, x0 as x1, y0 as y1, x0 + w as x2, y0 + d as y2 from p
        union all select parcel_id, 1, x0 + w, y0 + d, x0 + w - d, y0 + h + d from p
        union all select parcel_id, 2, x0 + w - d, y0 + h + d, x0 - d, y0 + h from p
        union all select parcel_id, 3, x0 - d, y0 + h, x0, y0 from p"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = ADAPTERS[name]
    return spark.sql(sql.replace(f"from {source}", f"from {{{source}}}"), **{source: table(spark, sf_dir, source)})
