"""Queries over event descriptors and model comparisons."""

from pyspark.sql import functions as F

from checks.evaluation import EVENT_METRICS, LONG, TRUTH, per_event, scored, split_of, state
from checks.registry import check
from emberline.operators import evaluation as ev, reporting
from emberline.session import durable

ECD, BOTH = "event_cell_day", "event_cell_day predictions"
MODELS = ["a", "b"]
SPLIT = "case event_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end"
DESC = f"""
dm as (select event_id, day_idx, min(day) as day, avg(wind_u) as u, avg(wind_v) as v from event_cell_day group by all),
wd as (select event_id, count(*) as n_days, min(day) as date_first, max(day) as date_last, avg(sqrt(u * u + v * v)) as mean_wind_speed,
   degrees(sqrt(greatest(-2 * ln(greatest(sqrt(power(avg(cos(atan2(v, u))), 2) + power(avg(sin(atan2(v, u))), 2)), 1e-12)), 0))) as wind_dir_circ_std_deg from dm group by event_id),
d0 as (select event_id, stddev_pop(elevation) as elevation_std_m, avg(slope_deg) as mean_slope_deg,
   avg((fuel_type in (90, 91, 92, 93, 99))::int) as nonflammable_fraction from event_cell_day where day_idx = 0 group by event_id),
al as (select event_id, avg(temperature) as mean_temperature, avg(relative_humidity) as mean_relative_humidity, count(distinct row) as height,
   count(distinct col) as width, count(distinct case when fire_mask >= 0.5 then row * 50 + col end) as true_cells_final from event_cell_day group by event_id),
ds as (select *, {SPLIT} as split from wd join d0 using (event_id) join al using (event_id)),
dl as (select event_id, split, unnest(['true_cells_final', 'wind_dir_circ_std_deg', 'mean_wind_speed', 'elevation_std_m', 'mean_slope_deg', 'nonflammable_fraction']) as descriptor,
   unnest([true_cells_final, wind_dir_circ_std_deg, mean_wind_speed, elevation_std_m, mean_slope_deg, nonflammable_fraction]) as value from ds),
rk as (select c.event_id, c.split, c.descriptor, c.value, (count(*) filter (where t.value < c.value) + 0.5 * count(*) filter (where t.value = c.value)) / count(*) as rank,
   min(t.value) as train_min, max(t.value) as train_max from dl c join dl t on t.descriptor = c.descriptor and t.split = 'train' where c.split <> 'train' group by all)"""


def descriptors(spark, d):
    return reporting.event_descriptors(state(spark, d)).withColumn("split", split_of("event_id"))


def cases_and_train(spark, d):
    # rounding makes equal values equal in both engines before they are ranked
    long = durable(reporting.long_descriptors(descriptors(spark, d)))
    return long.filter("split <> 'train'"), long.filter("split = 'train'")


def with_split(spark, d):
    return per_event(spark, d).withColumn("split", split_of("event_id"))


def aggregate(spark, d):
    return ev.bootstrap_ci(durable(per_event(spark, d)))


@check("a14_event_descriptors", "event_id:i split:s n_days:i date_first:d date_last:d height:i width:i true_cells_final:i mean_wind_speed:f wind_dir_circ_std_deg:f elevation_std_m:f mean_slope_deg:f nonflammable_fraction:f mean_temperature:f mean_relative_humidity:f",
       ECD, DESC + ", result as (select * from ds)")
def _(spark, d):
    return descriptors(spark, d)


@check("a19_percentile_rank", "event_id:i descriptor:s value:f rank:f", ECD, DESC + ", result as (select * from rk)")
def _(spark, d):
    return reporting.percentile_rank(*cases_and_train(spark, d))


@check("a20_descriptor_analysis", "event_id:i descriptor:s value:f rank:f train_min:f train_max:f flag:s hypothesis:s", ECD, DESC + """,
fl as (select *, value < train_min or value > train_max as o, case descriptor when 'true_cells_final' then 'size' when 'wind_dir_circ_std_deg' then 'wind'
   when 'mean_wind_speed' then 'windspeed' when 'nonflammable_fraction' then 'fuel' else 'terrain' end as theme from rk),
result as (select *, case when o then 'outside' when rank >= 0.75 then 'high' when rank <= 0.25 then 'low' else 'inside' end as flag,
  case when o or (rank >= 0.75 and theme <> 'size') or (theme = 'size' and rank <= 0.25) then theme end as hypothesis from fl)""")
def _(spark, d):
    return reporting.descriptor_analysis(*cases_and_train(spark, d))


@check("f13_failing_cases", "model:s event_id:i iou:f", BOTH, EVENT_METRICS + ", result as (select * from per_event where iou < 0.3)")
def _(spark, d):
    return reporting.failing_cases(per_event(spark, d))


RANKED = LONG + """,
ranked as (select *, row_number() over (partition by metric order by case when metric in ('iou', 'dice') then -point else point end, model) as rank from agg)"""


@check("w7_rank_models", "model:s metric:s point:f rank:i", BOTH, RANKED + ", result as (select * from ranked)")
def _(spark, d):
    return reporting.rank_models(aggregate(spark, d), MODELS)


@check("a21_best_model_per_metric", "metric:s best:s point:f overlapping:s verdict:s", BOTH, RANKED + """,
result as (select b.metric, b.model as best, b.point, coalesce(string_agg(o.model, ',' order by o.model), '') as overlapping,
  case when count(o.model) > 0 then 'not distinguishable' else 'distinct' end as verdict
  from ranked b left join agg o on o.metric = b.metric and o.model <> b.model and b.lower <= o.upper and o.lower <= b.upper
  where b.rank = 1 group by all)""")
def _(spark, d):
    return reporting.best_model_per_metric(aggregate(spark, d), MODELS)


@check("a22_all_intervals_overlap", "metric:s overlap:i", BOTH, LONG + """,
result as (select metric, (max(lower) <= min(upper))::int as overlap from agg group by metric)""")
def _(spark, d):
    return reporting.all_intervals_overlap(aggregate(spark, d)).withColumn("overlap", F.col("all_overlap").cast("int"))


@check("a23_comparison_table", "metric:s a_point:f a_lower:f a_upper:f b_point:f b_lower:f b_upper:f", BOTH, LONG + """,
result as (select metric, max(point) filter (where model = 'a') as a_point, max(lower) filter (where model = 'a') as a_lower, max(upper) filter (where model = 'a') as a_upper,
  max(point) filter (where model = 'b') as b_point, max(lower) filter (where model = 'b') as b_lower, max(upper) filter (where model = 'b') as b_upper from agg group by metric)""")
def _(spark, d):
    return reporting.comparison_table(aggregate(spark, d), MODELS)


@check("a23_per_event_table", "model:s event_id:i iou:f dice:f brier:f ece:f", BOTH, EVENT_METRICS + ", result as (select * from per_event)")
def _(spark, d):
    return reporting.per_event_table(per_event(spark, d), MODELS)


@check("a24_case_direction", "model:s event_id:i pred_cells:i true_cells:i ratio:f direction:s", BOTH, TRUTH + """,
fin as (select model, event_id, count(*) filter (where p >= 0.5) as pred_cells, count(*) filter (where y = 1) as true_cells
  from scored s where day_idx = (select max(day_idx) from event_cell_day e where e.event_id = s.event_id) group by all),
result as (select *, case when true_cells > 0 then pred_cells / true_cells end as ratio,
  case when true_cells = 0 then null when pred_cells / true_cells < 0.5 then 'under' when pred_cells / true_cells > 2 then 'over' end as direction from fin)""")
def _(spark, d):
    return reporting.case_direction(scored(spark, d))


@check("a28_case_listing", "split:s event_id:i judge:s iou:f quality:s", BOTH, EVENT_METRICS + f""",
result as (select {SPLIT} as split, event_id, 'b' as judge, iou, case when iou >= 0.3 then 'good' else 'bad' end as quality
  from per_event where model = 'b' and event_id % 3 <> 0)""")
def _(spark, d):
    return reporting.case_listing(with_split(spark, d), MODELS, "b")


@check("a29_data_date_range", "split:s date_first:d date_last:d n_events:i", ECD, DESC + """,
result as (select split, min(date_first) as date_first, max(date_last) as date_last, count(*) as n_events from ds group by rollup (split))""")
def _(spark, d):
    return reporting.data_date_range(descriptors(spark, d))
