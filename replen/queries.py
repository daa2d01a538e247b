"""Registered queries of the operators, each with the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replen.functions.change import banded
from replen.functions.sku import age_category
from replen.operators import accuracy, allocation, forecasting, inventory, maintenance, materials, orders, priority, reports, selection, series, stats
from replen.operators.adhoc import QuerySpec, query
from replen.plans import summary as plans
from replen.sources import fixtures as fx

AS_OF = fx.AS_OF
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None = None, whole: str = ""):
    """Register a query under its function's name, and the SQL (over the feeds) of its result.

    whole: columns that SQL sums in 128 bits and that are cast to 64.
    """

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            casts = ", ".join(f"cast({c} as bigint) as {c}" for c in whole.split())
            full = fx.with_fixtures(sql)
            ORACLE[f.__name__] = f"select * replace ({casts}) from ({full})" if casts else full
        return f

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def months(spark: SparkSession, d: str, entity: str = "model") -> DataFrame:
    return stats.monthly(fx.history(spark, d), entity, AS_OF)


def types(spark: SparkSession, d: str, entity: str = "model") -> DataFrame:
    return stats.classify(stats.entity_stats(months(spark, d, entity)), AS_OF)


def latest_forecast(spark: SparkSession, d: str) -> DataFrame:
    return inventory.version_as_of(fx.forecast(spark, d), date(2001, 8, 3))


def whole_summary(spark: SparkSession, d: str, entity: str = "sku") -> DataFrame:
    meta = fx.bom(spark, d).select("model", F.col("main_material_name").alias("material"))
    return plans.full_summary(fx.sales(spark, d), fx.stock(spark, d), latest_forecast(spark, d), meta, AS_OF, entity)


def _stats_sql(level: str) -> str:
    """Common table expressions k (statistics and type), z (factor) and r (safety stock and reorder point) of a level."""
    return f"""
        g as (select entity, count(*) as n_months, sum(quantity) as quantity, avg(quantity) as average, stddev_samp(quantity) as sd, min(first_sale) as first_sale
              from months_{level} group by entity),
        h as (select *, coalesce(sd / average, 0) as cv from g),
        k as (select *, case when first_sale > date '2001-08-15' - 365 then 'new' when cv < 0.6 then 'basic' when cv > 1.0 then 'seasonal' else 'regular' end as type from h),
        m as (select entity, month(month) as calendar_month, avg(recent) as mean from months_{level} where recent is not null group by all),
        i as (select *, mean / avg(mean) over (partition by entity) as idx from m),
        z as (select k.*, coalesce(i.idx > 1.2, false) as in_season, case type when 'basic' then 2.5 when 'new' then 1.8 when 'regular' then 1.645
                     else case when coalesce(i.idx > 1.2, false) then 1.85 else 1.5 end end::double as f
              from k left join i on i.entity = k.entity and i.calendar_month = 8),
        r as (select *, f * sd * sqrt(1.36::double) as safety_stock, average * 1.36::double + f * sd * sqrt(1.36::double) as rop from z)"""


_SUMMARY = (
    _stats_sql("sku")
    + """,
        st as (select sku as entity, sum(available_stock) as stock, avg(net_price) as price from fx_stock
               where snapshot_date = (select max(snapshot_date) from fx_stock) group by sku),
        fc as (select sku as entity, sum(forecast) as forecast from fx_forecast
               where generated_date = date '2001-08-01' and forecast_date >= date '2001-09-01' and forecast_date < date '2001-10-01' group by sku),
        p as (select r.*, coalesce(stock, 0) as stock, coalesce(price, 0) as price, coalesce(fc.forecast, 0) as forecast
              from r left join st using (entity) left join fc using (entity)),
        q as (select *, stock * price as value, coalesce(stock < rop, false) as below_rop, greatest(0, coalesce(rop - stock, 0)) as deficit,
                     coalesce((stock - rop) / nullif(rop, 0) * 100, 0) as overstock_percent from p),
        x as (select *, case when stock <= 0 and forecast > 0 then 100 when stock > 0 and stock < rop then (rop - stock) / rop * 80 else 0 end as risk,
                     forecast * price as revenue from q),
        y as (select *, case when max(revenue) over () > 0 then revenue / max(revenue) over () * 100 else 0 end as impact from x),
        pr as (select *, (risk * 0.5 + impact * 0.3 + least(forecast, 100) * 0.2)
                      * case type when 'new' then 1.2 when 'seasonal' then 1.3 when 'basic' then 0.9 else 1.0 end as score,
                      stock <= 0 and forecast > 0 as urgent from y)"""
)


# Statistics and inventory


@registered(_stats_sql("model") + " select entity, n_months, quantity, round(average, 6) as average, round(sd, 6) as sd, round(cv, 6) as cv, type, in_season, round(safety_stock, 6) as safety_stock, round(rop, 6) as rop from r", whole="quantity")
def reorder_points_by_model(spark, d):
    out = plans.reorder_points(fx.sales(spark, d), "model", AS_OF)
    return rounded(out.select("entity", "n_months", "quantity", "average", "sd", "cv", "type", "in_season", "safety_stock", "rop"))


@registered(_stats_sql("sku") + " select entity, n_months, quantity, round(average, 6) as average, round(sd, 6) as sd, type, in_season, round(safety_stock, 6) as safety_stock, round(rop, 6) as rop from r", whole="quantity")
def reorder_points_by_sku(spark, d):
    out = plans.reorder_points(fx.sales(spark, d), "sku", AS_OF)
    return rounded(out.select("entity", "n_months", "quantity", "average", "sd", "type", "in_season", "safety_stock", "rop"))


@registered(_SUMMARY + """ select pr.entity, type, round(rop, 6) as rop, stock, price, value, below_rop, round(deficit, 6) as deficit, round(overstock_percent, 6) as overstock_percent,
    forecast, main_material_name as material from pr left join fx_bom b on b.model = substring(pr.entity, 1, 5)""", whole="stock forecast")
def full_summary(spark, d):
    return rounded(whole_summary(spark, d).select("entity", "type", "rop", "stock", "price", "value", "below_rop", "deficit", "overstock_percent", "forecast", "material"))


@registered("""s as (
    select 'sku' as entity_type, sku as entity_id, * from fx_sales union all select 'model', model, * from fx_sales)
    select entity_type, entity_id, date_trunc('month', sale_date)::date as month, sum(quantity) as total_quantity, round(sum(total_amount), 2) as total_revenue,
           count(*) as transaction_count, count(distinct order_id) as unique_orders, round(avg(unit_price), 6) as avg_unit_price from s group by all""", whole="total_quantity")
def monthly_aggregation(spark, d):
    out = stats.monthly_aggregation(fx.sales(spark, d))
    return rounded(out.withColumn("total_revenue", F.round("total_revenue", 2)))


@registered("""m as (select entity, month(month) as calendar_month, avg(recent) as mean from months_model where recent is not null group by all)
    select entity, calendar_month, round(mean, 6) as mean, round(mean / avg(mean) over (partition by entity), 6) as index, mean / avg(mean) over (partition by entity) > 1.2 as in_season from m""")
def seasonal_index(spark, d):
    return rounded(stats.seasonal_index(months(spark, d)))


@registered("x as (select entity, avg(recent) as v from months_sku where recent is not null group by entity) select entity, round(v, 2) as recent_average from x")
def recent_average(spark, d):
    return rounded(stats.recent_average(months(spark, d, "sku")), 2)


@registered("x as (select model, color, year(sale_date) as year, sum(quantity) as quantity from fx_history group by all) select * from x", whole="quantity")
def yearly_sales(spark, d):
    return stats.yearly_sales(fx.history(spark, d), ["model", "color"])


@registered("x as (select model, color, year(forecast_date) as year, sum(forecast) as forecast from fx_forecast where generated_date = date '2001-08-01' and forecast_date >= date '2001-08-01' group by all) select * from x", whole="forecast")
def yearly_forecast(spark, d):
    return stats.yearly_forecast(latest_forecast(spark, d), ["model", "color"], AS_OF)


@registered("""k as (select month, row_number() over (order by month desc) as rk from (select distinct month from months_sku)),
    a as (select m.*, rk, lower(substring(entity, 1, 2)) as pre, (select max(rk) from k) as known from months_sku m join k using (month))
    select entity, sum(quantity) as period_sales from a where (pre in ('ch', 'ni', 'dz') and rk <= 2) or (pre in ('do', 'ju') and known > 12 and rk between 11 and 12) group by entity""", whole="period_sales")
def period_sales(spark, d):
    return stats.period_sales(months(spark, d, "sku"), 1.36)


@registered("x as (select model, min(sale_date) as first_sale from fx_history group by model) select * from x where first_sale > date '2001-08-15' - 365")
def new_models(spark, d):
    return stats.new_models(fx.history(spark, d), AS_OF)


@registered("x as (select entity, sum(quantity) as quantity from months_sku group by entity) select * from x order by quantity desc, entity limit 50", whole="quantity")
def volume_ranking(spark, d):
    return stats.volume_ranking(months(spark, d, "sku"), 50)


@registered("x as (select * from fx_stock) select sku, snapshot_date, available_stock from x where snapshot_date = (select max(snapshot_date) from x)")
def latest_stock(spark, d):
    return inventory.latest_snapshot(fx.stock(spark, d)).select("sku", "snapshot_date", "available_stock")


@registered("x as (select sku, max(snapshot_date) as snapshot_date, arg_max(available_stock, snapshot_date) as available_stock from fx_stock group by sku) select * from x")
def latest_stock_per_sku(spark, d):
    return inventory.latest_per_key(fx.stock(spark, d), ["sku"], ["snapshot_date"]).select("sku", "snapshot_date", "available_stock")


@registered("x as (select sku, forecast_date, arg_max(forecast, generated_date) as forecast from fx_forecast group by all) select * from x")
def latest_forecast_per_day(spark, d):
    return inventory.latest_per_key(fx.forecast(spark, d), ["sku", "forecast_date"], ["generated_date"]).select("sku", "forecast_date", "forecast")


@registered("x as (select generated_date, sum(forecast) as forecast, count(*) as n from fx_forecast where generated_date = date '2001-03-01' group by 1) select * from x", whole="forecast")
def forecast_version_as_of(spark, d):
    rows = inventory.version_as_of(fx.forecast(spark, d), inventory.accuracy_target(date(2001, 7, 1)), 14)
    return rows.groupBy("generated_date").agg(F.sum("forecast").alias("forecast"), F.count("*").alias("n"))


@registered(_SUMMARY + """ select count(*) as n, count(*) filter (where below_rop) as n_below_rop, round(sum(deficit), 4) as total_deficit,
    round(count(*) filter (where below_rop) * 100.0 / count(*), 4) as percent_below, count(*) filter (where overstock_percent >= 20) as n_overstocked,
    count(*) filter (where overstock_percent < 20 and not below_rop) as n_normal, sum(stock) as total_stock, round(sum(value), 4) as total_value from pr""", whole="total_stock")
def stock_kpis(spark, d):
    return rounded(inventory.stock_kpis(whole_summary(spark, d)), 4)


@registered(_SUMMARY + " select entity, type, stock from pr left join fx_bom b on b.model = substring(pr.entity, 1, 5) where below_rop and type in ('basic', 'regular') and coalesce(main_material_name, '') <> 'fabric1' and entity like '%00%'", whole="stock")
def summary_filters(spark, d):
    return whole_summary(spark, d).where(inventory.matches("00", below_rop=True, types=["basic", "regular"], not_materials=["fabric1"])).select("entity", "type", "stock")


@registered("""s as (select sku as entity, snapshot_date, sum(available_stock) as stock from fx_stock group by all),
    b as (select max(snapshot_date) as last, min(snapshot_date) as first from fx_stock),
    p as (select entity, max(snapshot_date) filter (where stock > 0) as last_in_stock, max(snapshot_date) as seen, arg_max(stock, snapshot_date) as stock from s group by entity)
    select entity, last_in_stock, date_diff('day', coalesce(last_in_stock, first), last) as days_out from p, b
    where (seen < last or stock <= 0) and date_diff('day', coalesce(last_in_stock, first), last) > 0""")
def out_of_stock_streaks(spark, d):
    return inventory.out_of_stock_streaks(fx.stock(spark, d), "sku")


_PROJECTION = _SUMMARY + """,
    pf as (select sku as entity, forecast_date as date, 1 as step, sum(forecast)::double as demand from fx_forecast
           where generated_date = date '2001-08-01' and forecast_date between date '2001-08-15' and date '2002-08-15' and sku in (select entity from pr where rop is not null) group by all),
    ps as (select entity, date '2001-08-15' as date, 0 as step, 0.0::double as demand from pr where rop is not null union all select * from pf),
    pj as (select ps.entity, date, step, demand, stock - sum(demand) over (partition by ps.entity order by date, step rows unbounded preceding) as projected, rop from ps join pr using (entity))"""


def _projected(spark, d):
    starts = whole_summary(spark, d).where("rop is not null").select("entity", "stock", "rop")
    return inventory.projection(starts, latest_forecast(spark, d).withColumnRenamed("sku", "entity"), AS_OF)


@registered(_PROJECTION + " select entity, date, step, demand, projected, round(rop, 6) as rop, projected <= rop as below_rop, projected <= 0 as out_of_stock from pj")
def stock_projection(spark, d):
    return rounded(_projected(spark, d))


@registered(_PROJECTION + """, c as (select entity, min(date) filter (where projected <= rop) as rop_date, min(date) filter (where projected <= 0) as zero_date from pj group by entity)
    select *, date_diff('day', date '2001-08-15', zero_date) as days_to_zero, coalesce(date_diff('day', date '2001-08-15', zero_date) <= 30, false) as critical from c""")
def projection_crossings(spark, d):
    return inventory.crossings(_projected(spark, d), AS_OF)


# Priorities


@registered(_SUMMARY + " select entity, type, round(risk, 6) as risk, round(impact, 6) as impact, round(score, 6) as score, urgent from pr")
def order_priorities(spark, d):
    return rounded(priority.prioritise(whole_summary(spark, d)).select("entity", "type", "risk", "impact", "score", "urgent"))


_ROLLUP = _SUMMARY + """,
    mc as (select substring(entity, 1, 5) as model, substring(entity, 6, 2) as color, avg(score) as score, sum(deficit) as deficit, sum(forecast) as forecast, sum(stock) as stock,
                  bool_or(urgent) as urgent, greatest(0, sum(forecast) - sum(stock)) as coverage_gap from pr group by all)"""


@registered(_ROLLUP + " select model, color, round(score, 6) as score, round(deficit, 6) as deficit, forecast, stock, urgent, coverage_gap from mc", whole="forecast stock coverage_gap")
def priorities_by_model_color(spark, d):
    out = priority.by_model_color(priority.prioritise(whole_summary(spark, d)))
    return rounded(out.select("model", "color", "score", "deficit", "forecast", "stock", "urgent", "coverage_gap"))


@registered(_ROLLUP + """, t as (select * from mc order by score desc, model, color limit 10)
    select t.model, t.color, round(t.score, 6) as score, string_agg(substring(entity, 8, 2) || ':' || floor(greatest(pr.deficit, pr.forecast))::bigint, ', ' order by substring(entity, 8, 2)) as sizes
    from t join pr on substring(entity, 1, 5) = t.model and substring(entity, 6, 2) = t.color group by t.model, t.color, t.score""")
def order_recommendations(spark, d):
    return rounded(plans.recommendations(whole_summary(spark, d)).select("model", "color", "score", "sizes"))


@registered(_SUMMARY + """, k2 as (select month, row_number() over (order by month desc) as rk from (select distinct month from months_sku)),
    ps as (select entity, sum(quantity) as period_sales from months_sku join k2 using (month) where rk between 11 and 12 group by entity)
    select entity, round(case when greatest(coalesce(period_sales, 0), forecast) > 0 then greatest(0, greatest(coalesce(period_sales, 0), forecast) + coalesce(safety_stock, 0) - stock) else 0 end, 6) as order_quantity
    from pr left join ps using (entity)""")
def order_quantities(spark, d):
    rows = whole_summary(spark, d).join(stats.period_sales(months(spark, d, "sku"), 1.36, force_seasonal=True), "entity", "left")
    rows = priority.forecast_for_new_adults(rows)
    return rounded(priority.order_quantity(rows, seasonal=True).select("entity", "order_quantity"))


# Reports


_WEEK = """wk as (select *, case when prior > 0 then (current - prior) * 100.0 / prior when current > 0 then 999 else 0 end as change, current - prior as difference from pd)"""


@registered("""f as (select model, min(sale_date) as f0 from fx_history group by model), n as (select * from f where f0 between date '2001-08-15' - 60 and date '2001-08-15'),
    b as (select model, f0, least(f0 + 60, date '2001-08-15') as e from n),
    g as (select model, cast(unnest(generate_series(f0 - (isodow(f0)::int + 4) % 7, e - (isodow(e)::int + 4) % 7, interval 7 days)) as date) as week from b),
    s as (select h.model, sale_date - (isodow(sale_date)::int + 4) % 7 as week, sum(quantity) as quantity from fx_history h join b using (model) where sale_date <= e group by all)
    select g.model, g.week, coalesce(s.quantity, 0) as quantity, (select min(product_name) from fx_stock t where t.model = g.model) as product_name from g left join s on s.model = g.model and s.week = g.week""", whole="quantity")
def weekly_new_products(spark, d):
    return reports.weekly_new_products(fx.history(spark, d), fx.stock(spark, d), AS_OF)


@registered("""pd as (select model, coalesce(sum(quantity) filter (where sale_date between date '2001-08-06' and date '2001-08-12'), 0) as current,
        coalesce(sum(quantity) filter (where sale_date between date '2000-08-07' and date '2000-08-13'), 0) as prior from fx_sales
        where sale_date between date '2001-08-06' and date '2001-08-12' or sale_date between date '2000-08-07' and date '2000-08-13' group by model), """ + _WEEK + """
    (select 'rising' as star, model, current, prior, difference, round(change, 6) as change from wk order by difference desc, model limit 1)
    union all (select 'falling', model, current, prior, difference, round(change, 6) from wk order by difference, model limit 1)""", whole="current prior difference")
def weekly_stars(spark, d):
    return rounded(reports.stars(fx.sales(spark, d), AS_OF))


@registered(_stats_sql("model") + """, w as (select model, color, sum(quantity) as quantity from fx_sales where sale_date between date '2001-08-06' and date '2001-08-12' group by all)
    select model, color, w.quantity, type, row_number() over (partition by type order by w.quantity desc, model, color) as rank from w join k on k.entity = w.model qualify rank <= 5""", whole="quantity")
def top_products_by_type(spark, d):
    return reports.top_by_type(fx.sales(spark, d), types(spark, d), AS_OF).select("model", "color", "quantity", "type", "rank")


_YOY = """pd as (select model, color, coalesce(sum(quantity) filter (where sale_date >= date '2001-01-01'), 0) as current,
        coalesce(sum(quantity) filter (where sale_date < date '2001-01-01'), 0) as prior from fx_sales
        where sale_date between date '2001-01-01' and date '2001-07-31' or sale_date between date '2000-01-01' and date '2000-07-31' group by all)"""
_CHANGE = "round(case when sum(prior) > 0 then (sum(current) - sum(prior)) * 100.0 / sum(prior) when sum(current) > 0 then 999 else 0 end, 6) as change"


@registered(_YOY + f""", c as (select podgrupa, kategoria, current, prior from pd left join fx_category using (model))
    select podgrupa, kategoria, 0 as level, sum(current) as current, sum(prior) as prior, sum(current) - sum(prior) as difference, {_CHANGE} from c group by all
    union all select podgrupa, null, 1, sum(current), sum(prior), sum(current) - sum(prior), {_CHANGE} from c where podgrupa is not null group by podgrupa""", whole="current prior difference")
def yoy_by_category(spark, d):
    return rounded(reports.yoy_by_category(fx.sales(spark, d), fx.category(spark, d), AS_OF))


@registered(_YOY + f"""select color, model, 0 as level, sum(current) as current, sum(prior) as prior, sum(current) - sum(prior) as difference, {_CHANGE} from pd group by all
    union all select color, null, 1, sum(current), sum(prior), sum(current) - sum(prior), {_CHANGE} from pd group by color""", whole="current prior difference")
def yoy_by_color(spark, d):
    return rounded(reports.yoy_by_color(fx.sales(spark, d), AS_OF))


@registered(_YOY + """, c as (select podgrupa, sum(current) as current, sum(prior) as prior from pd join fx_category using (model) group by 1)
    select sum(current) as current, sum(prior) as prior, count(*) filter (where current > prior) as n_rising, count(*) filter (where current < prior) as n_falling,
           round(case when sum(prior) > 0 then (sum(current) - sum(prior)) * 100.0 / sum(prior) else 999 end, 6) as change,
           (select count(distinct model) from pd where current > 0 and model not in (select model from fx_category)) as uncategorised_models,
           (select coalesce(sum(current), 0) from pd where model not in (select model from fx_category)) as uncategorised_sales from c""", whole="current prior uncategorised_sales")
def yoy_kpis(spark, d):
    return rounded(reports.yoy_kpis(fx.sales(spark, d), fx.category(spark, d), AS_OF))


@registered("""l as (select distinct month from months_sku order by month desc limit 4), o as (select *, substring(entity, 6, 2) as color from months_sku where entity like 'DO001%'),
    c as (select color, month from (select distinct color from o), l), q as (select color, month, sum(quantity) as quantity from o group by all)
    select color, month, coalesce(quantity, 0) as quantity from c left join q using (color, month)""", whole="quantity")
def sales_by_color_last_months(spark, d):
    return reports.color_months(months(spark, d, "sku"), "DO001")


@registered("""p as (select model, color, sum(quantity) as quantity, count(distinct date_trunc('month', sale_date)) as n_months from fx_sales where sale_date between date '2000-08-01' and date '2001-08-15' group by all)
    select model, color, quantity, n_months, round(quantity / n_months, 6) as per_month, main_material_name as material_type from
    (select * from p order by quantity / n_months, model, color limit 20) left join fx_bom using (model)""", whole="quantity")
def worst_models(spark, d):
    meta = fx.bom(spark, d).select("model", F.col("main_material_name").alias("material_type"))
    return rounded(reports.worst_models(fx.sales(spark, d), meta, AS_OF))


@registered("""p as (select model, sum(quantity) as quantity, min(sale_date) as first_sale, date_diff('day', min(sale_date), date '2001-08-15') / 30.44::double as n_months from fx_history group by model)
    select model, quantity, first_sale, round(n_months, 6) as n_months, round(quantity / n_months, 6) as per_month from p where n_months > 0 and quantity > 0 order by quantity / n_months, model limit 20""", whole="quantity")
def worst_rotating_models(spark, d):
    return rounded(reports.worst_rotating(fx.history(spark, d), AS_OF))


_YEARLY = """ys as (select model, year(sale_date) as year, sum(quantity) as quantity from fx_history group by all),
    yf as (select model, year(forecast_date) as year, sum(forecast) as forecast from fx_forecast where generated_date = date '2001-08-01' and forecast_date >= date '2001-08-01' group by all)"""


def _yearly(spark, d):
    return stats.yearly_sales(fx.history(spark, d), ["model"]), stats.yearly_forecast(latest_forecast(spark, d), ["model"], AS_OF)


@registered(_YEARLY + """, w as (select model, coalesce(sum(quantity) filter (where year = 1999), 0) as two_years_ago, coalesce(sum(quantity) filter (where year = 2000), 0) as last_year,
        coalesce(sum(quantity) filter (where year = 2001), 0) as this_year from ys where year >= 1999 group by model)
    select w.*, coalesce((select sum(forecast) from yf where yf.model = w.model), 0) as forecast,
           round(case when two_years_ago > 0 then (last_year - two_years_ago) * 100.0 / two_years_ago when last_year > 0 then 100 else 0 end, 6) as change from w""", whole="two_years_ago last_year this_year forecast")
def yearly_summary(spark, d):
    return rounded(reports.yearly_summary(*_yearly(spark, d), AS_OF))


@registered(_YEARLY + " select model, year, 'actual' as kind, quantity::double as quantity from ys union all select model, year, 'forecast', forecast::double from yf where year >= 2001")
def yearly_trend(spark, d):
    return reports.yearly_trend(*_yearly(spark, d), AS_OF)


# Series, accuracy and forecasting


@registered("""b as (select entity, min(month) as lo, max(month) as hi from months_model group by entity),
    s as (select entity, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as month from b)
    select s.entity, s.month, coalesce(quantity, 0) as quantity from s left join months_model m on m.entity = s.entity and m.month = s.month""", whole="quantity")
def filled_months(spark, d):
    return series.filled(months(spark, d))


_FILLED = """b as (select entity, min(month) as lo, max(month) as hi from months_model group by entity),
    sp as (select entity, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as month from b where datediff('month', lo, hi) + 1 >= 12),
    fs as (select sp.entity, sp.month, coalesce(quantity, 0) as quantity from sp left join months_model m on m.entity = sp.entity and m.month = sp.month)"""


@registered(_FILLED + """select entity, month, quantity, lag(quantity, 1) over w as lag_1, lag(quantity, 12) over w as lag_12,
        round(avg(quantity) over (w rows between 3 preceding and 1 preceding), 6) as mean_3,
        round(coalesce(stddev_samp(quantity) over (w rows between 6 preceding and 1 preceding), 0), 6) as sd_6,
        coalesce(lag(quantity, 1) over w - lag(quantity, 13) over w, 0) as yoy, quarter(month) as quarter, round(sin(month(month) * (2 * pi() / 12)), 6) as month_sin
    from fs window w as (partition by entity order by month)""", whole="quantity lag_1 lag_12 yoy")
def series_features(spark, d):
    out = series.features(series.filled(months(spark, d), 12))
    return rounded(out.select("entity", "month", "quantity", "lag_1", "lag_12", "mean_3", "sd_6", "yoy", "quarter", "month_sin"))


_ROLLED = ", ".join(
    f"round(avg(quantity) over (w rows between {n} preceding and 1 preceding), 6) as mean_{n}, "
    f"round(coalesce(stddev_samp(quantity) over (w rows between {n} preceding and 1 preceding), 0), 6) as sd_{n}"
    for n in series.ROLLING
)
_LAGGED = ", ".join(f"coalesce(lag(quantity, {k}) over w, 0) as lag_{k}" for k in series.LAGS)


@registered(_stats_sql("model") + ", " + _FILLED + f""",
    ends as (select entity, max(month) as hi, arg_max(quantity, month) as quantity from fs group by entity),
    u as (select entity, month, quantity, 0 as step from fs union all
          select entity, cast(hi + to_months(cast(n as int)) as date), quantity, n from ends, range(1, 7) t(n)),
    l as (select *, {_LAGGED}, {_ROLLED}, coalesce(lag(quantity, 1) over w - lag(quantity, 13) over w, 0) as yoy,
                 round(coalesce((lag(quantity, 1) over w - lag(quantity, 13) over w) / nullif(lag(quantity, 13) over w, 0), 0), 6) as yoy_percent,
                 month(month) as calendar_month, quarter(month) as quarter, round(sin(month(month) * (2 * pi() / 12)), 6) as month_sin, round(cos(month(month) * (2 * pi() / 12)), 6) as month_cos
          from u window w as (partition by entity order by month))
    select l.*, coalesce(case type when 'basic' then 0 when 'regular' then 1 when 'seasonal' then 2 when 'new' then 3 end, 1) as type_code, round(coalesce(cv, 0.5), 6) as cv
    from l left join k using (entity) where step > 0""", whole="quantity yoy " + " ".join(f"lag_{k}" for k in series.LAGS))
def future_features(spark, d):
    return rounded(series.future_matrix(months(spark, d), types(spark, d), 6))


_GRID = """fd as (select model as entity, forecast_date as day, sum(forecast) as forecast from fx_daily group by all),
    ad as (select model as entity, sale_date as day, sum(quantity) as actual from fx_sales group by all),
    sd as (select model as entity, snapshot_date as day, sum(available_stock) as stock from fx_stock group by all),
    gr as (select fd.entity, fd.day, forecast, coalesce(actual, 0) as actual,
                  coalesce(last_value(stock ignore nulls) over (partition by fd.entity order by fd.day rows unbounded preceding) > 0, true) as had_stock
           from fd left join ad on ad.entity = fd.entity and ad.day = fd.day left join sd on sd.entity = fd.entity and sd.day = fd.day),
    ac as (select entity, avg(abs(forecast - actual) / actual) filter (where had_stock and actual > 0) * 100 as mape, avg((forecast - actual) / actual) filter (where had_stock and actual > 0) * 100 as bias,
                  avg(abs(forecast - actual)) filter (where had_stock) as mae, sqrt(avg((forecast - actual) * (forecast - actual)) filter (where had_stock)) as rmse,
                  sum(forecast) filter (where had_stock) as total_forecast, sum(actual) filter (where had_stock) as total_actual,
                  count(*) filter (where had_stock) as n_days, count(*) filter (where not had_stock) as n_days_out, coalesce(sum(forecast) filter (where not had_stock), 0) as missed from gr group by entity)"""


def _grid(spark, d):
    stock = fx.stock(spark, d)
    return accuracy.daily_grid(fx.sales(spark, d), fx.forecast_daily(spark, d), stock, date(2001, 5, 16), date(2001, 7, 30), "model")


@registered(_GRID + " select entity, round(mape, 6) as mape, round(bias, 6) as bias, round(mae, 6) as mae, round(rmse, 6) as rmse, total_forecast, total_actual, n_days, n_days_out, missed from ac", whole="total_forecast total_actual missed")
def forecast_accuracy(spark, d):
    return rounded(accuracy.accuracy(_grid(spark, d)))


@registered(_GRID + ", " + _stats_sql("model") + " select coalesce(type, 'unknown') as type, count(*) as n, round(avg(mape), 6) as mape, round(avg(rmse), 6) as rmse, sum(missed) as missed from ac left join k using (entity) group by 1", whole="missed")
def accuracy_by_type(spark, d):
    return rounded(accuracy.by_type(accuracy.accuracy(_grid(spark, d)), types(spark, d)).select("type", "n", "mape", "rmse", "missed"))


@registered(_GRID + """select date_trunc('week', day)::date as period, round(avg(abs(forecast - actual) / actual) filter (where had_stock and actual > 0) * 100, 6) as mape,
    round(avg((forecast - actual) / actual) filter (where had_stock and actual > 0) * 100, 6) as bias, count(*) filter (where had_stock and actual > 0) as n from gr group by 1 having n > 0""")
def accuracy_trend(spark, d):
    return rounded(accuracy.trend(_grid(spark, d)))


@registered(_GRID + " select count(*) as n, round(avg(mape), 6) as mape, sum(total_forecast) as total_forecast, round(greatest(0, 1 - abs(sum(total_forecast) - sum(total_actual)) / sum(total_actual)) * 100, 6) as volume_accuracy from ac", whole="total_forecast")
def accuracy_overall(spark, d):
    return rounded(accuracy.overall(accuracy.accuracy(_grid(spark, d))).select("n", "mape", "total_forecast", "volume_accuracy"))


@registered(_GRID + " select case when mape < 20 then 'good' when mape < 40 then 'acceptable' else 'poor' end as band, count(*) as n from ac group by 1")
def accuracy_bands(spark, d):
    return accuracy.accuracy(_grid(spark, d)).groupBy(banded(F.col("mape"), accuracy.MAPE_BANDS, "poor").alias("band")).agg(F.count("*").alias("n"))


_MA = _FILLED + """, rk as (select *, row_number() over (partition by entity order by month desc) as r, max(month) over (partition by entity) as last from fs),
    ma as (select entity, any_value(last) as last, sum(quantity * case r when 3 then 0.5 when 2 then 0.3 else 0.2 end::double) as f from rk where r <= 3 group by entity)"""


@registered(_MA + " select entity, cast(last + to_months(cast(h as int)) as date) as month, round(f, 6) as forecast, round(f * 0.8, 6) as lower, round(f * 1.2, 6) as upper, 'moving_avg' as method from ma, range(1, 7) r(h)")
def moving_average_forecast(spark, d):
    return rounded(forecasting.moving_average(forecasting.as_arrays(series.filled(months(spark, d), 12)), 6))


@registered()
def batch_forecast(spark, d):
    return forecasting.forecast_all(months(spark, d, "sku"), types(spark, d, "sku"), 6)


@registered()
def forecast_cross_validation(spark, d):
    return forecasting.best_method(forecasting.cross_validate(series.filled(months(spark, d), 15)))


def _compared(spark, d):
    sales = fx.sales(spark, d)
    past = stats.monthly(sales.where(F.col("sale_date") < "2001-05-01"), "model")
    own = forecasting.moving_average(forecasting.as_arrays(series.filled(past, 12)), 3)
    vendor = fx.forecast(spark, d).where("generated_date = date '2001-03-01'").select(F.col("model").alias("entity"), F.col("forecast_date").alias("month"), "forecast")
    return accuracy.compare(accuracy.align(own, vendor, stats.monthly(sales, "model")))


_COMPARED = """pm as (select model as entity, date_trunc('month', sale_date)::date as month, sum(quantity) as quantity from fx_sales where sale_date < date '2001-05-01' group by all),
    b as (select entity, min(month) as lo, max(month) as hi from pm group by entity),
    sp as (select entity, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as month from b where datediff('month', lo, hi) + 1 >= 12),
    fs as (select sp.entity, sp.month, coalesce(quantity, 0) as quantity from sp left join pm on pm.entity = sp.entity and pm.month = sp.month),
    rk as (select *, row_number() over (partition by entity order by month desc) as r, max(month) over (partition by entity) as last from fs),
    ma as (select entity, any_value(last) as last, sum(quantity * case r when 3 then 0.5 when 2 then 0.3 else 0.2 end::double) as f from rk where r <= 3 group by entity),
    im as (select entity, cast(last + to_months(cast(h as int)) as date) as month, f as internal from ma, range(1, 4) r(h)),
    ve as (select model as entity, forecast_date as month, sum(forecast) as external from fx_forecast where generated_date = date '2001-03-01' group by all),
    re as (select model as entity, date_trunc('month', sale_date)::date as month, sum(quantity) as actual from fx_sales group by all),
    al as (select entity, month, internal, coalesce(external, 0) as external, coalesce(actual, 0) as actual from im left join ve using (entity, month) left join re using (entity, month)),
    cp as (select entity, count(*) as n_months, avg(abs(internal - actual) / actual) * 100 as im, avg(abs(external - actual) / actual) * 100 as em from al where actual > 0 group by entity),
    cw as (select *, case when im < em then 'internal' when im > em then 'external' else 'tie' end as winner, coalesce((em - im) / nullif(em, 0) * 100, 0) as improvement from cp)"""


@registered(_COMPARED + " select entity, n_months, round(im, 6) as internal_mape, round(em, 6) as external_mape, winner, round(improvement, 6) as improvement from cw")
def forecast_comparison(spark, d):
    return rounded(_compared(spark, d).select("entity", "n_months", "internal_mape", "external_mape", "winner", "improvement"))


@registered(_COMPARED + ", " + _stats_sql("model") + " select coalesce(type, 'unknown') as type, count(*) as n, count(*) filter (where winner = 'internal') as internal_wins, round(avg(em), 6) as external_mape from cw left join k using (entity) group by 1")
def comparison_by_type(spark, d):
    return rounded(accuracy.compare_by_type(_compared(spark, d), types(spark, d)).select("type", "n", "internal_wins", "external_mape"))


@registered(_COMPARED + " select count(*) as n, count(*) filter (where winner = 'internal') as internal_wins, round(avg(im), 6) as internal_mape, round(median(improvement), 6) as median_improvement from cw")
def comparison_overall(spark, d):
    return rounded(accuracy.compare_overall(_compared(spark, d)).select("n", "internal_wins", "internal_mape", "median_improvement"))


# Materials and orders


_NEEDS = """pq as (select model, sum(total_quantity) as quantity from fx_order where status = 'active' and total_quantity > 0 group by model),
    ex as (select model, main_material_name as material, 'main' as kind, main_m * quantity as meters, main_kg * quantity as kg from pq join fx_bom using (model)
           union all select model, 'ribbing ' || ribbing_type, 'ribbing', ribbing_m * quantity, 0 from pq join fx_bom using (model) where ribbing_type is not null and ribbing_m > 0
           union all select model, 'lining', 'lining', lining_m * quantity, 0 from pq join fx_bom using (model) where lining_m > 0),
    rq as (select material, sum(meters) as meters, sum(kg) as kg, string_agg(distinct model, ', ' order by model) as models, count(distinct model) as n_models from ex group by material)"""


def _required(spark, d):
    made = materials.production_quantities(fx.orders(spark, d).where("status = 'active'"))
    return materials.requirements(materials.explode_bom(made, fx.bom(spark, d)))


@registered(_NEEDS + " select material, round(meters, 4) as meters, round(kg, 4) as kg, models, n_models from rq")
def material_requirements(spark, d):
    return rounded(_required(spark, d), 4)


@registered(_NEEDS + """, sk as (select main_material_name as material, count(*) * 1000.0::double as stock_meters, count(*) * 10.0::double as stock_kg from fx_bom group by 1)
    select material, round(meters - coalesce(stock_meters, 0), 4) as gap_meters, round(kg - coalesce(stock_kg, 0), 4) as gap_kg from rq left join sk using (material)""")
def material_gap(spark, d):
    held = fx.bom(spark, d).select(F.col("main_material_name").alias("material"), F.lit(1000.0).alias("quantity_meters"), F.lit(10.0).alias("quantity_kg"))
    return rounded(materials.gap(_required(spark, d), held).select("material", "gap_meters", "gap_kg"), 4)


@registered("""x as (select facility, count(*) as n_orders, sum(total_quantity) as quantity from fx_order group by facility) select facility, n_orders, quantity, round(quantity / 50000.0 * 100, 4) as use_percent, round(quantity / 12500.0, 4) as weeks_ahead,
    case when quantity < 37500 then 'free' when quantity < 50000 then 'normal' when quantity < 75000 then 'busy' when quantity < 100000 then 'full' when quantity < 125000 then 'over'
         when quantity < 150000 then 'far over' else 'overloaded' end as status from x""", whole="quantity")
def facility_load(spark, d):
    capacity = fx.orders(spark, d).select("facility").distinct().withColumn("capacity", F.lit(50_000.0))
    return rounded(materials.facility_load(fx.orders(spark, d), capacity).drop("capacity"), 4)


@registered("x as (select order_id, date_diff('day', order_date, date '2001-08-15') as days from fx_order where status = 'active') select order_id, days, days >= 42 as ready, greatest(0, 42 - days) as days_left from x")
def order_ages(spark, d):
    return materials.order_ages(fx.orders(spark, d), AS_OF).select("order_id", "days", "ready", "days_left")


@registered("""h as (select model, color, size, sum(quantity) as quantity from fx_history group by all)
    select model, color, size, quantity, round(quantity / sum(quantity) over (partition by model, color), 6) as priority from h""", whole="quantity")
def size_priorities(spark, d):
    return rounded(allocation.size_priorities(fx.history(spark, d)))


def pattern_table(spark: SparkSession) -> DataFrame:
    """Pairs of neighbouring sizes, one piece each: the pattern set of the examples."""
    rows = [(i, f"{s:02d}", 1) for i in range(1, 7) for s in (i, i + 1)]
    return spark.createDataFrame(rows, "pattern_id int, size string, count int")


@registered()
def pattern_allocation(spark, d):
    demand = priority.size_quantities(priority.prioritise(whole_summary(spark, d)))
    uses = allocation.allocate(demand, pattern_table(spark))
    return allocation.produced(allocation.parity(uses), pattern_table(spark), demand)


@registered("""c as (select model, color, sum(forecast) as quantity from fx_forecast where generated_date = date '2001-08-01' group by all),
    s as (select model, color, sum(quantity) as sales_12m from fx_history where sale_date >= date '2000-08-15' group by all),
    t as (select model, color, sum(available_stock) as stock from fx_stock where snapshot_date = date '2001-08-13' group by all),
    a as (select c.*, coalesce(sales_12m, 0) as sales_12m, greatest(0, coalesce(sales_12m, 0) - coalesce(stock, 0)) as cap from c left join s using (model, color) left join t using (model, color)),
    b as (select *, least(quantity, cap) as kept, cap - least(quantity, cap) as room from a),
    e as (select *, least(sum(quantity - kept) over m, sum(room) over m) as given, sum(room) over m as rooms, sum(room) over (partition by model order by sales_12m desc, color rows unbounded preceding) as upto from b window m as (partition by model))
    select model, color, quantity, cap, cast(kept + coalesce(floor(upto * given / nullif(rooms, 0)), 0) - coalesce(floor((upto - room) * given / nullif(rooms, 0)), 0) as bigint) as capped from e where cap > 0""", whole="quantity cap")
def capped_colors(spark, d):
    rows = latest_forecast(spark, d).groupBy("model", "color").agg(F.sum("forecast").alias("quantity"))
    sold = fx.history(spark, d).where("sale_date >= date '2000-08-15'").groupBy("model", "color").agg(F.sum("quantity").alias("sales_12m"))
    held = inventory.latest_snapshot(fx.stock(spark, d)).groupBy("model", "color").agg(F.sum("available_stock").alias("stock"))
    rows = rows.join(sold, ["model", "color"], "left").join(held, ["model", "color"], "left").fillna(0, ["sales_12m", "stock"])
    return allocation.cap_colors(rows)


# Ingest and maintenance


@registered("x as (select count(*) as n, count(distinct sku) as n_skus, count(distinct order_id) as n_orders, min(sale_date) as first_day, max(sale_date) as last_day, round(sum(total_amount), 2) as revenue from fx_sales) select * from x")
def data_summary(spark, d):
    return rounded(maintenance.data_summary(fx.sales(spark, d)), 2)


@registered("x as (select podgrupa, count(*) as n from fx_category group by podgrupa) select * from x")
def category_distribution(spark, d):
    return maintenance.category_distribution(fx.category(spark, d))


@registered("""k as (select distinct order_id, sku, sale_date from fx_sales) select count(*) as n from k where sale_date >= date '2001-06-01'""")
def insert_ignore(spark, d):
    rows = fx.sales(spark, d).select("order_id", "sku", "sale_date")
    return maintenance.insert_ignore(rows.where("sale_date < date '2001-06-01'"), rows, ["order_id", "sku", "sale_date"]).agg(F.count("*").alias("n"))


@registered("x as (select sku, arg_max(available_stock, snapshot_date) as available_stock from fx_stock group by sku) select sku, available_stock from x")
def upsert_stock(spark, d):
    stock = fx.stock(spark, d).select("sku", "snapshot_date", "available_stock")
    held = stock.where("snapshot_date = date '2001-08-06'")
    return maintenance.upsert(held, stock.where("snapshot_date = date '2001-08-13'"), ["sku"]).select("sku", "available_stock")


@registered("""s as (select 'sku' as entity_type, sku as entity_id, * from fx_sales union all select 'model', model, * from fx_sales)
    select entity_type, count(*) as n, sum(quantity) as quantity from (select entity_type, entity_id, date_trunc('month', sale_date) as month, sum(quantity) as quantity from s group by all) group by entity_type""", whole="quantity")
def refreshed_after_batch(spark, d):
    sales = fx.sales(spark, d)
    batch = sales.where("sale_date >= date '2001-08-01'")
    keys = maintenance.touched(batch)
    on = sales.join(keys.where("entity_type = 'model'").select(F.col("entity_id").alias("model")), "model", "left_semi")
    out = maintenance.refreshed(stats.monthly_aggregation(sales.where("sale_date < date '2001-08-01'")), stats.monthly_aggregation(on), keys)
    return out.groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("total_quantity").alias("quantity"))


# Ad-hoc questions


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"sales": fx.history(spark, d), "stock": inventory.latest_snapshot(fx.stock(spark, d)), "forecast": latest_forecast(spark, d), "stats": plans.reorder_points(fx.sales(spark, d), "sku", AS_OF)}


@registered("x as (select model, sum(quantity) as total from fx_history group by model) select * from x order by total desc, model limit 10", whole="total")
def ask_top_models(spark, d):
    return query(QuerySpec("sales", group_by="model", limit=10, as_of=AS_OF), tables(spark, d))


@registered("x as (select date_trunc('month', sale_date)::date as month, round(sum(total_amount), 2) as total from fx_history where sale_date >= date '2001-08-15' - 730 group by 1) select * from x")
def ask_monthly_value(spark, d):
    return rounded(query(QuerySpec("sales", group_by="month", metric="value", last=(2, "years"), as_of=AS_OF), tables(spark, d)), 2)


@registered(_stats_sql("sku") + " select s.sku, available_stock from fx_stock s join r on r.entity = s.sku where snapshot_date = date '2001-08-13' and available_stock < rop and type = 'seasonal'")
def ask_seasonal_low_stock(spark, d):
    return query(QuerySpec("stock", below_rop=True, types=("seasonal",), as_of=AS_OF), tables(spark, d)).select("sku", "available_stock")


@registered("f as (select model, 'Plant F' || bn % 4 as facility from fx_model) select sku, available_stock from fx_stock join f using (model) where snapshot_date = date '2001-08-13' and facility in ('Plant F1') and available_stock >= 10 and available_stock < 40")
def ask_stock_of_a_facility(spark, d):
    facilities = fx.models(spark, d).select("model", F.concat(F.lit("Plant F"), (F.col("bn") % 4).cast("string")).alias("facility"))
    spec = QuerySpec("stock", facility="f1", where=(("available_stock", ">=", 10), ("available_stock", "<", 40)), as_of=AS_OF)
    return query(spec, tables(spark, d) | {"facilities": facilities}).select("sku", "available_stock")


@registered(_stats_sql("sku") + " select model, cast(sum(available_stock) as bigint) as total from fx_stock s join r on r.entity = s.sku where snapshot_date = date '2001-08-13' and available_stock > rop + safety_stock and available_stock <= 46 group by model")
def ask_overstock_by_model(spark, d):
    return query(QuerySpec("stock", overstock=True, group_by="model", where=(("available_stock", "<=", 46),), as_of=AS_OF), tables(spark, d)).select("model", F.col("total").cast("long").alias("total"))


@registered("x as (select color, sum(forecast) as total from fx_forecast where generated_date = date '2001-08-01' and model = 'DO001' group by color) select * from x", whole="total")
def ask_forecast_by_color(spark, d):
    return query(QuerySpec("forecast", models=("do001",), group_by="color", as_of=AS_OF), tables(spark, d))


@registered("x as (select podgrupa, sum(quantity) as total from fx_history join fx_category using (model) group by podgrupa) select * from x", whole="total")
def ask_category_breakdown(spark, d):
    rows = tables(spark, d)["sales"].join(fx.category(spark, d), "model")
    return rows.groupBy("podgrupa").agg(F.sum("quantity").alias("total"))


@registered("x as (select case when substring(lower(model), 1, 2) in ('ch', 'ni', 'dz') then 'children' else 'adult' end as age, sum(quantity) as total from fx_history group by 1) select * from x", whole="total")
def sales_by_age(spark, d):
    return fx.history(spark, d).groupBy(age_category(F.col("model")).alias("age")).agg(F.sum("quantity").alias("total"))


# Selection and order shaping


@registered("""e as (select distinct substring(sku, 1, 7) as k from fx_sku where bn = 3 and color = '01')
    select sku, sum(available_stock) as stock from fx_stock where substring(sku, 1, 7) not in (select k from e) group by sku""", whole="stock")
def without_excluded_colors(spark, d):
    excluded = fx.skus(spark, d).where("bn = 3 and color = '01'")
    return selection.without(fx.stock(spark, d), excluded, "model_color").groupBy("sku").agg(F.sum("available_stock").alias("stock"))


@registered(_ROLLUP + """ select mc.model, mc.color, round(mc.score, 6) as score, main_material_name as material from mc left join fx_bom using (model)
    where mc.model not in (select model from fx_order where status = 'active' and order_date >= date '2001-07-01') and main_material_name in ('fabric1', 'fabric2', 'fabric4')""")
def order_candidates(spark, d):
    rolled = priority.by_model_color(priority.prioritise(whole_summary(spark, d)))
    meta = fx.bom(spark, d).select("model", F.lit("F1").alias("facility"), F.col("main_material_name").alias("material"))
    recent = fx.orders(spark, d).where("order_date >= date '2001-07-01'")
    rows = selection.order_candidates(rolled, recent, meta, materials=["fabric1", "fabric2", "fabric4"])
    return rounded(rows.select("model", "color", "score", "material"))


@registered("""r as (select *, substring(entity, 1, 5) as model, substring(entity, 6, 2) as color, substring(entity, 8, 2) as size from months_sku),
    k as (select *, dense_rank() over (partition by model, color order by month desc) as rk from r)
    select model, color, size, sum(quantity) as sold from k where rk <= 4 group by all""", whole="sold")
def size_sales_history(spark, d):
    return orders.size_history(months(spark, d, "sku"))


@registered("""r as (select *, substring(entity, 1, 5) as model, substring(entity, 8, 2) as size from months_sku),
    k as (select *, dense_rank() over (partition by model order by month desc) as rk from r)
    select model, month, size, sum(quantity) as quantity from k where rk <= 3 group by all""", whole="quantity")
def size_sales_by_month(spark, d):
    return orders.size_months(months(spark, d, "sku"))


@registered("""x as (select model, size, sum(quantity) as produced from fx_history group by all)
    select model, size, produced, round(produced * 100.0 / sum(produced) over (partition by model), 6) as percent from x""", whole="produced")
def size_distribution(spark, d):
    return rounded(orders.size_distribution(fx.history(spark, d).withColumnRenamed("quantity", "produced")))


@registered("""c as (select * from (values ('01', 'XS'), ('02', 'S'), ('03', 'M'), ('04', 'L'), ('05', 'XL')) a(code, alias))
    select model, color, coalesce(alias, size) as name, sum(available_stock) as stock from fx_stock left join c on code = size where snapshot_date = date '2001-08-13' group by all""", whole="stock")
def stock_by_color_size(spark, d):
    aliases = spark.createDataFrame([("01", "XS"), ("02", "S"), ("03", "M"), ("04", "L"), ("05", "XL")], "code string, alias string")
    return orders.stock_by_color_size(inventory.latest_snapshot(fx.stock(spark, d)), aliases)


@registered("x as (select distinct facility as value from fx_order) select value from x")
def facility_choices(spark, d):
    return selection.choices(fx.orders(spark, d), "facility")


@registered("x as (select order_id, order_date, model from fx_order where status = 'active') select * from x")
def active_orders(spark, d):
    return orders.active_orders(fx.orders(spark, d)).select("order_id", "order_date", "model")


@registered()
def pooled_ml_forecast(spark, d):
    """One pooled model over all models' series, chosen of four by its error on the last months and fitted again on all, and its forecasts."""
    matrix = series.training_matrix(months(spark, d), types(spark, d))
    _, model, _, residuals = forecasting.fit_pooled(matrix, date(2001, 3, 1))
    return forecasting.predict_pooled(model, series.future_matrix(months(spark, d), types(spark, d), 3), forecasting.residual_sds(residuals))
