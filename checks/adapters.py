"""SQL views of the same inputs that `emberline.sources.fixtures` derives in Spark."""

DAY0 = "date '2024-01-01'"

ADAPTERS = {
    "detections_raw": """
        select cast(cast(lat_e6 / 1e6 as decimal(9,6)) as varchar) as latitude,
               cast(cast(lon_e6 / 1e6 as decimal(9,6)) as varchar) as longitude,
               strftime(ts, '%Y-%m-%d') as acq_date, cast(hour(ts) * 100 + minute(ts) as varchar) as acq_time,
               case when event_id % 3 = 0 then 'N20' else 'N' end as satellite, 'VIIRS' as instrument,
               case when event_id % 7 = 0 then 'h' when event_id % 7 < 3 then 'l' else 'n' end as confidence,
               case when event_id % 11 = 0 then '' else cast(cast(value as decimal(10,2)) as varchar) end as frp,
               case when copy = 0 then '2024-02-01' else '2024-02-02' end as download_date,
               copy, event_id as eid
        from (select e.*, unnest(case when event_id % 7 = 0 then [0, 1] else [0] end) as copy,
                -39000000 + ((user_id * 1103) % 2500) % 50 * 50000 + (event_id * 7919) % 41 * 700 as lat_e6,
                -73600000 + ((user_id * 1103) % 2500) // 50 * 50000 + (event_id * 104729) % 37 * 700 as lon_e6
              from events e) x""",
    # first delivery wins; depends on detections_raw
    "detections": """
        select cast(latitude as double) as latitude, cast(longitude as double) as longitude,
               cast(acq_date || ' ' || substr(lpad(acq_time, 4, '0'), 1, 2) || ':' || substr(lpad(acq_time, 4, '0'), 3, 2)
                    || ':00' as timestamp) as detected_at,
               cast(nullif(frp, '') as double) as frp, confidence, satellite, instrument, acq_date, acq_time
        from (select *, row_number() over (
                partition by acq_date, acq_time, round(cast(latitude as double), 6), round(cast(longitude as double), 6),
                satellite order by copy, eid) as rn from detections_raw) y where rn = 1""",
    "weather_hourly": f"""
        select c_custkey as cell_id, {DAY0} + cast(h // 24 as int) as day, h % 24 as hour,
               cast(280 + (c_custkey * 7 + h * 3) % 25 as double) as t2m,
               cast(272 + (c_custkey * 5 + h * 2) % 15 as double) as d2m,
               cast((c_custkey * 3 + h) % 13 - 6 as double) as u10, cast((c_custkey + h * 5) % 11 - 5 as double) as v10,
               case when h % 24 = 0 then cast(24 * (c_custkey % 9) as double)
                    else cast((h % 24) * (c_custkey % 9) as double) end / 10000 as tp
        from customer cross join range(49) t(h)""",
    "reflectance_obs": f"""
        select c_custkey as cell_id, s as scene, {DAY0} + cast(s * 5 as int) as scene_day, (s * 13) % 100 as cloud_cover,
               (c_custkey * 5 + s * 3) % 12 as scl, cast((c_custkey * 31 + s * 17) % 1500 - 50 as double) as red,
               cast(200 + (c_custkey * 57 + s * 91) % 3200 as double) as nir
        from customer cross join range(8) t(s)""",
    "cells": """
        select p_partkey as cell_id, p_partkey // 50 as row, p_partkey % 50 as col,
               cast(100 + ((p_partkey // 50) * 13 + (p_partkey % 50) * 7 + p_size * 3) % 200 as double) as elevation,
               [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 30, 0][p_partkey % 13 + 1] as landcover
        from part""",
    "event_cell_day": f"""
        select k // 500 as event_id, d as day_idx, {DAY0} + cast(d as int) as day, k // 50 as row, k % 50 as col,
               cast((k + d) % 11 - 5 as double) as wind_u, cast((k * 3 + d) % 9 - 4 as double) as wind_v,
               cast((k * 11) % 45 as double) as slope_deg,
               cast(100 + (k // 50) % 20 * 13 + (k % 50) * 7 % 30 + p_size as double) as elevation,
               cast(280 + (k * 7 + d * 3) % 25 as double) as temperature,
               case when (k + d) % 17 <> 0 then cast(20 + (k * 5 + d) % 60 as double) end as relative_humidity,
               [1.0, 2.0, 3.0, 4.0, 5.0, 90.0, 91.0, 92.0, 93.0, 99.0][(k * 3) % 10 + 1]::double as fuel_type,
               case when d >= 1 and (k * 37 + d * 11) % 97 < 6 + 4 * d then 1.0::double else 0.0::double end as fire_mask
        from (select p_partkey as k, p_size from part) p cross join range(5) t(d)""",
    "predictions": """
        select model, k // 500 as event_id, d as day_idx, k // 50 as row, k % 50 as col,
               cast(case when model = 'a' then (k * 37 + d * 7) % 97 else 96 - (k * 37 + d * 11 + 5) % 97 end as double) / 97 as p
        from (select p_partkey as k from part) p cross join range(5) t(d) cross join (values ('a'), ('b')) m(model)""",
    "footprints": f"""
        select k as event_id, cast(-7350 + (k * 37) % 50 * 4 as double) / 100 as west,
               cast(-3900 + (k * 23) % 50 * 4 as double) / 100 as south,
               cast(-7348 + (k * 37) % 50 * 4 as double) / 100 as east,
               cast(-3898 + (k * 23) % 50 * 4 as double) / 100 as north,
               {DAY0} + cast((k * 7) % 12 + k // 100 * 20 as int) as first_day,
               {DAY0} + cast((k * 7) % 12 + k // 100 * 20 + k % 4 as int) as last_day
        from (select s_suppkey as k from supplier) s""",
}
