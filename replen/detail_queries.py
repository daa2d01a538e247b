"""Registered queries of the operators that the headline queries do not use: selections, ingest, order shaping, stores and summaries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from replen.functions.change import trend
from replen.functions.sku import size_sort_key, with_sku_parts
from replen.operators import accuracy, allocation, entity_models, forecasting, inventory, maintenance, materials, orders, priority, reports, selection, series, states, stats, stock_intervals
from replen.plans import summary as plans
from replen.queries import _FILLED, _SUMMARY, AS_OF, ORACLE, QUERIES, latest_forecast, months, registered, rounded, types, whole_summary
from replen.sources import digests, discovery, files
from replen.sources import fixtures as fx

__all__ = ["ORACLE", "QUERIES"]

# Sources and ingest


@registered("x as (select * from fx_forecast) select sku, forecast_date, forecast from x where generated_date = (select max(generated_date) from x)")
def newest_forecast_version(spark, d):
    return inventory.newest_version(fx.forecast(spark, d)).select("sku", "forecast_date", "forecast")


@registered("x as (select sku, snapshot_date, available_stock from fx_stock where snapshot_date between date '2001-07-01' and date '2001-07-31') select * from x")
def stock_history(spark, d):
    return inventory.history_between(fx.stock(spark, d), date(2001, 7, 1), date(2001, 7, 31)).select("sku", "snapshot_date", "available_stock")


@registered("x as (select order_id, sku, sale_date, quantity from fx_sales where bn % 2 = 0 and sale_date between date '2001-03-01' and date '2001-03-31') select * from x")
def valid_sales_of_march(spark, d):
    rows = fx.sales(spark, d).withColumn("is_valid", F.col("bn") % 2 == 0)
    return selection.valid_sales(rows, date(2001, 3, 1), date(2001, 3, 31)).select("order_id", "sku", "sale_date", "quantity")


@registered("x as (select m.model, bn, main_material_name from fx_model m left join fx_bom using (model)) select * from x")
def models_with_material(spark, d):
    return maintenance.with_bom_name(fx.models(spark, d), fx.bom(spark, d)).select("model", "bn", "main_material_name")


@registered("""x as (select case when bn % 3 = 0 then null when bn % 7 = 0 then model || 'x' else model end as model, grupa, podgrupa, case when bn % 4 = 1 then kategoria end as kategoria
                from fx_category join fx_model m using (model))
    select count(*) as n, count(*) filter (where model is null) as null_models, count(*) filter (where length(model) <> 5) as odd_models, count(*) filter (where grupa is null) as null_grupa,
           count(*) filter (where podgrupa is null) as null_podgrupa, count(*) filter (where kategoria is null) as null_kategoria from x""")
def category_quality(spark, d):
    rows = fx.category(spark, d).join(fx.models(spark, d), "model").withColumn("kategoria", F.when(F.col("bn") % 4 == 1, F.col("kategoria")))
    return maintenance.category_quality(rows.withColumn("model", F.when(F.col("bn") % 3 == 0, None).when(F.col("bn") % 7 == 0, F.concat("model", F.lit("x"))).otherwise(F.col("model"))))


@registered("""x as (select substring(sku, 1, 9 - bn % 6) as key from fx_sku)
    select key, case when length(key) >= 5 then substring(key, 1, 5) end as model, case when length(key) >= 7 then substring(key, 6, 2) end as color,
           case when length(key) >= 9 then substring(key, 8, 2) end as size from x""")
def sku_parts(spark, d):
    rows = fx.skus(spark, d).select(F.substr("sku", F.lit(1), 9 - F.col("bn") % 6).alias("key"))
    return with_sku_parts(rows, "key")


@registered("x as (select order_id, sale_date, sku, quantity from fx_sales) select *, substring(sku, 1, 5) as model, substring(sku, 6, 2) as color, substring(sku, 8, 2) as size, strftime(sale_date, '%Y-%m') as year_month, 'b1' as batch_id, 'f-' || year(sale_date) as source_file from x")
def sales_records(spark, d):
    raw = fx.sales(spark, d).select("order_id", "sale_date", "sku", "quantity")
    return maintenance.sales_records(raw, "b1", F.concat(F.lit("f-"), F.year("sale_date")))


@registered("x as (select sku, forecast_date, forecast from fx_forecast) select *, substring(sku, 1, 5) as model, substring(sku, 6, 2) as color, substring(sku, 8, 2) as size, date '2001-08-01' as generated_date, 'vendor' as source from x")
def forecast_records(spark, d):
    return maintenance.forecast_records(fx.forecast(spark, d).select("sku", "forecast_date", "forecast"), date(2001, 8, 1), "vendor")


@registered("x as (select sku, available_stock from fx_stock) select *, substring(sku, 1, 5) as model, substring(sku, 6, 2) as color, substring(sku, 8, 2) as size, date '2001-08-13' as snapshot_date, 'file' as source from x")
def stock_records(spark, d):
    return maintenance.stock_records(fx.stock(spark, d).select("sku", "available_stock"), date(2001, 8, 13), "file")


@registered("""x as (select 's3/' || c_custkey || '.csv' as path, case when c_nationkey % 2 = 0 then 'sales' else 'stock' end as file_type, sha256(c_mktsegment || c_nationkey) as file_hash, c_custkey from customer)
    select path, file_type, file_hash from x where not exists (select 1 from x y where y.c_custkey % 10 = 0 and y.file_type = x.file_type and y.file_hash = x.file_hash)""")
def unseen_files(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    kind = F.when(F.col("c_nationkey") % 2 == 0, "sales").otherwise("stock").alias("file_type")
    content = F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).cast("binary").alias("content")
    listing = c.select(F.concat(F.lit("s3/"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"), kind, content)
    seen = c.where(F.col("c_custkey") % 10 == 0).select(kind, F.sha2(content, 256).alias("file_hash"))
    return maintenance.new_files(listing, seen).select("path", "file_type", "file_hash")


@registered("""x as (select 's3/' || c_custkey || '.csv' as path, case when c_nationkey % 2 = 0 then 'sales' else 'stock' end as file_type, sha256(c_mktsegment || c_nationkey || c_custkey % 40) as file_hash, c_custkey from customer)
    select min(path) as path, file_type, file_hash, 'imported' as status from x where (file_type, file_hash) not in (select file_type, file_hash from x where c_custkey % 10 = 0) group by file_type, file_hash""")
def admitted_files(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    kind = F.when(F.col("c_nationkey") % 2 == 0, "sales").otherwise("stock").alias("file_type")
    content = F.concat("c_mktsegment", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 40).cast("string"))
    listing = c.select(F.concat(F.lit("s3/"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"), kind, F.sha2(content, 256).alias("file_hash"), "c_custkey")
    seen = listing.where(F.col("c_custkey") % 10 == 0)
    return maintenance.import_log(maintenance.admitted(listing.drop("c_custkey"), seen))


def file_digests(spark, d):
    """Digests of the tables' own files, in ranges of a megabyte; SQL cannot read them (a test compares with hashlib)."""
    return digests.file_digests(discovery.listing(spark, d, "*.parquet"), length=1 << 20).select("name", "length", "file_hash")


QUERIES["file_digests"] = file_digests


@registered("x as (select facility as file_type, status, count(*) as n from fx_order group by all) select * from x")
def import_counts(spark, d):
    return maintenance.import_counts(fx.orders(spark, d).select(F.col("facility").alias("file_type"), "status"))


@registered("x as (select sku, forecast_date, generated_date, forecast from fx_forecast where generated_date <> date '2001-03-01') select * from x")
def new_forecast_generations(spark, d):
    rows = fx.forecast(spark, d).select("sku", "forecast_date", "generated_date", "forecast")
    return maintenance.new_generations(rows.where(F.col("generated_date") == F.lit(date(2001, 3, 1))), rows.unionByName(rows))


@registered("""x as (select 'latest_stock' as view, count(distinct sku) as rows_before, count(*) as rows_after from fx_stock where snapshot_date = date '2001-08-13'
    union all select 'latest_forecast', 0, count(*) from fx_forecast where generated_date = date '2001-08-01') select *, rows_after - rows_before as changed from x""")
def refreshed_views(spark, d):
    stock, forecast = inventory.latest_snapshot(fx.stock(spark, d)), inventory.newest_version(fx.forecast(spark, d))
    return maintenance.refresh({"latest_stock": stock}, {"latest_stock": stock, "latest_forecast": forecast})


@registered("x as (select sku, sale_date, count(*) as n from fx_sales group by all) select * from x where n > 1")
def duplicate_sales_days(spark, d):
    return maintenance.duplicate_keys(fx.sales(spark, d), ["sku", "sale_date"])


_VERSIONS = """v as (select model, color, year(sale_date) as cache_version, sum(quantity) as quantity from fx_history group by all),
    w as (select *, (cache_version + cast(color as int)) % 3 <> 0 as is_valid from v)"""


def versions(spark, d):
    rows = fx.history(spark, d).groupBy("model", "color", F.year("sale_date").alias("cache_version")).agg(F.sum("quantity").alias("quantity"))
    return rows.withColumn("is_valid", (F.col("cache_version") + F.col("color").cast("int")) % 3 != 0)


@registered(_VERSIONS + " select * from w where is_valid qualify cache_version = max(cache_version) over (partition by model, color)", whole="quantity")
def latest_valid_versions(spark, d):
    return maintenance.latest_version(versions(spark, d), ["model", "color"])


@registered(_VERSIONS + ", l as (select * from w where is_valid qualify cache_version = max(cache_version) over (partition by model, color)) select model, color, quantity from l order by quantity desc, model, color limit 25", whole="quantity")
def top_valid_versions(spark, d):
    return maintenance.top_versioned(versions(spark, d), ["model", "color"], "quantity", 25).select("model", "color", "quantity")


@registered("x as (select model, bn, case when bn % 3 = 0 then 'a' else 'b' end as configuration_hash from fx_model) select * from x where configuration_hash = 'a'")
def usable_cache(spark, d):
    return maintenance.usable(fx.models(spark, d).withColumn("configuration_hash", F.when(F.col("bn") % 3 == 0, "a").otherwise("b")), "a")


# Selections


@registered("e as (select distinct model from fx_sku where bn % 6 = 0) select sku from fx_sku where model not in (select model from e)")
def without_excluded_models(spark, d):
    s = fx.skus(spark, d)
    return selection.without(s, s.where("bn % 6 = 0"), "model").select("sku")


@registered("e as (select sku from fx_sku where c = s) select sku from fx_sku where sku not in (select sku from e)")
def without_excluded_skus(spark, d):
    s = fx.skus(spark, d)
    return selection.without(s, s.where("cast(color as int) = cast(size as int)")).select("sku")


@registered("a as (select distinct sku from fx_stock where available_stock > 20) select s.sku, s.bn from fx_sku s join a using (sku)")
def active_products(spark, d):
    stock = fx.stock(spark, d).withColumn("is_active", F.col("available_stock") > 20)
    return selection.active_only(fx.skus(spark, d), stock).select("sku", "bn")


@registered("x as (select entity, month, quantity from months_model where month <= date '2000-06-01') select * from x", whole="quantity")
def months_until_cutoff(spark, d):
    return selection.until_month(months(spark, d), date(2000, 6, 20)).select("entity", "month", "quantity")


@registered("x as (select order_id, sku, sale_date from fx_sales where sale_date between date '2001-02-01' and date '2001-04-10') select * from x")
def sales_in_period(spark, d):
    return selection.in_period(fx.sales(spark, d), date(2001, 2, 17), date(2001, 4, 10)).select("order_id", "sku", "sale_date")


@registered("""o as (select sku, min(product_name) as product_name from fx_stock where snapshot_date = date '2001-08-13' group by sku), e as (select sku from fx_sku where c = 1 or bn % 11 = 3),
    x as (select sku, product_name, e.sku is not null as excluded from o full join e using (sku)) select * from x where upper(sku) like '%CH%' or upper(coalesce(product_name, '')) like '%CH%'""")
def excluded_products(spark, d):
    s = fx.skus(spark, d)
    stock = inventory.latest_snapshot(fx.stock(spark, d))
    return selection.exclusion_view(stock, s.where("color = '01' or bn % 11 = 3"), "ch")


_ALIASES = "al as (select * from (values ('01', 'XS'), ('02', 'S'), ('03', 'M'), ('04', 'L')) a(code, alias))"


def aliases(spark):
    return spark.createDataFrame([("01", "XS"), ("02", "S"), ("03", "M"), ("04", "L")], "code string, alias string")


@registered(_ALIASES + " select code, alias from al where alias in (select coalesce(b.alias, s.size) from fx_sku s left join al b on b.code = s.size where bn % 2 = 0 and s.size in ('01', '03', '07'))")
def aliases_in_use(spark, d):
    used = fx.skus(spark, d).where("bn % 2 = 0 and size in ('01', '03', '07')").join(aliases(spark), F.col("size") == F.col("code"), "left")
    return selection.alias_subset(aliases(spark), used.select(F.coalesce("alias", "size").alias("size")))


@registered(_ALIASES + " select distinct s.size, al.alias as code from fx_sku s join al on al.code = s.size")
def sizes_by_alias(spark, d):
    names = selection.reversed_aliases(aliases(spark)).select("code", F.col("alias").alias("size"))
    return fx.skus(spark, d).select("size").distinct().join(names, "size")


@registered("x as (select distinct size, case when bn % 2 = 0 then size else 'U' || size end as label from fx_sku) select label, coalesce(try_cast(label as int), 999) as place from x")
def size_order(spark, d):
    label = F.when(F.col("bn") % 2 == 0, F.col("size")).otherwise(F.concat(F.lit("U"), "size")).alias("label")
    return fx.skus(spark, d).select("size", label).distinct().select("label", size_sort_key(F.col("label")).alias("place"))


@registered("x as (select min(sale_date) as first_day, max(sale_date) as last_day from fx_sales) select * from x")
def sales_date_range(spark, d):
    return selection.date_range(fx.sales(spark, d))


@registered(_SUMMARY + " select entity from p where rop is not null and entity in (select sku from fx_forecast where forecast > 10)")
def projection_candidates(spark, d):
    known = latest_forecast(spark, d).unionByName(fx.forecast(spark, d)).where("forecast > 10").select(F.col("sku").alias("entity"))
    return selection.projection_candidates(whole_summary(spark, d), known)


@registered("x as (select model, grupa, '-' as nazwa2, 0 as rank from fx_category) select * from x")
def category_with_defaults(spark, d):
    return selection.with_defaults(fx.category(spark, d).select("model", "grupa"), grupa="none", nazwa2="-", rank=0)


# Statistics, reports and projections


@registered("x as (select model, sum(available_stock) as available_stock, round(sum(available_stock * net_price), 4) as value, min(product_name) as product_name from fx_stock where snapshot_date = date '2001-08-13' group by model) select * from x", whole="available_stock")
def stock_by_model(spark, d):
    return rounded(inventory.by_model(inventory.latest_snapshot(fx.stock(spark, d))), 4)


@registered("""w as (select model, color, sum(quantity) as quantity from fx_sales where sale_date between date '2001-08-06' and date '2001-08-12' group by all),
    n as (select model, color, min(product_name) as product_name from fx_stock group by all) select model, color, quantity, product_name from w left join n using (model, color)""", whole="quantity")
def week_with_descriptions(spark, d):
    week = fx.sales(spark, d).where("sale_date between '2001-08-06' and '2001-08-12'").groupBy("model", "color").agg(F.sum("quantity").alias("quantity"))
    return reports.with_descriptions(week, fx.stock(spark, d)).select("model", "color", "quantity", "product_name")


_WEEKLY = """f as (select model, min(sale_date) as first_sale from fx_sales group by model),
    nw as (select model, first_sale, least(first_sale + 60, date '2001-08-15') as until from f where first_sale between date '2001-08-15' - 60 and date '2001-08-15'),
    wk as (select model, until, first_sale, unnest(generate_series(first_sale - cast((isodow(first_sale) + 4) % 7 as int), until - cast((isodow(until) + 4) % 7 as int), interval 7 days))::date as week from nw),
    so as (select s.model, cast(sale_date - cast((isodow(sale_date) + 4) % 7 as int) as date) as week, sum(quantity) as quantity from fx_sales s join nw using (model) where sale_date <= until group by all),
    lg as (select model, week, coalesce(quantity, 0) as quantity from wk left join so using (model, week))"""


@registered(_WEEKLY + ", pm as (select model, sum(quantity) as quantity, count(*) as n_weeks from lg group by model) select count(*) as n_models, max(n_weeks) as n_weeks, sum(quantity) as total, count(*) filter (where quantity = 0) as n_without_sales from pm", whole="total")
def weekly_kpis(spark, d):
    return reports.weekly_kpis(reports.weekly_new_products(fx.sales(spark, d), fx.stock(spark, d), AS_OF))


@registered(_WEEKLY + ", n as (select model, min(product_name) as product_name from fx_stock group by model) select model, product_name, sum(quantity) filter (where week = date '2001-08-01') as \"2001-08-01\", sum(quantity) filter (where week = date '2001-08-08') as \"2001-08-08\" from lg left join n using (model) group by model, product_name", whole='"2001-08-01" "2001-08-08"')
def weekly_wide(spark, d):
    return reports.weekly_wide(reports.weekly_new_products(fx.sales(spark, d), fx.stock(spark, d), AS_OF), [date(2001, 8, 1), date(2001, 8, 8)])


@registered("""y as (select model, year(sale_date) as year, sum(quantity) as quantity from fx_history group by all),
    l as (select *, lag(quantity) over w as prior, lag(year) over w as prior_year from y window w as (partition by model order by year)),
    c as (select *, case when year < 2001 and prior_year = year - 1 then case when prior > 0 then (quantity - prior) / prior * 100 when quantity > 0 then 100 else 0 end end as pair from l),
    g as (select model, min(year) as first_year, count(*) as n_years, sum(quantity) as quantity, arg_max(pair, year) filter (where year < 2001 and pair is not null) as change from c group by model),
    a as (select model, sum(forecast) as forecast from fx_forecast where generated_date = date '2001-08-01' and forecast_date >= date '2001-08-01' group by model)
    select model, first_year, n_years, quantity, round(change, 6) as change, coalesce(forecast, 0) as forecast from g left join a using (model)""", whole="quantity forecast")
def trend_kpis(spark, d):
    yearly, ahead = stats.yearly_sales(fx.history(spark, d), ["model"]), stats.yearly_forecast(latest_forecast(spark, d), ["model"], AS_OF)
    return rounded(reports.trend_kpis(yearly, ahead, AS_OF))


@registered("""y as (select model, sum(quantity) filter (where year(sale_date) = 1999) as a, sum(quantity) filter (where year(sale_date) = 2000) as b from fx_history group by model),
    c as (select model, round((b - a) / a * 100, 6) as change from y where a > 0 and b > 0) select *, case when change > 10 then 'rising' when change < -10 then 'falling' else 'steady' end as trend from c""")
def model_trends(spark, d):
    of = lambda y: F.sum(F.when(F.year("sale_date") == y, F.col("quantity")))
    rows = fx.history(spark, d).groupBy("model").agg(of(1999).alias("a"), of(2000).alias("b")).where("a > 0 and b > 0")
    return rows.select("model", F.round((F.col("b") - F.col("a")) / F.col("a") * 100, 6).alias("change")).withColumn("trend", trend(F.col("change")))


@registered("""r as (select * from fx_history where sale_date >= date '2000-08-01' and sale_date <= date '2001-08-15'),
    g as (select model, color, sum(quantity) as quantity, count(distinct date_trunc('month', sale_date)) as n_months from r group by all),
    t as (select *, quantity / n_months as per_month from g order by per_month, model, color limit 60)
    select t.model, color, quantity, n_months, round(per_month, 6) as per_month, main_material_name as material_type from t join fx_bom using (model) where main_material_name in ('fabric1', 'fabric3') and color in ('00', '03', '05')""", whole="quantity")
def worst_models_filtered(spark, d):
    meta = fx.bom(spark, d).select("model", F.col("main_material_name").alias("material_type"))
    return rounded(reports.worst_models(fx.history(spark, d), meta, AS_OF, 60, materials=["fabric1", "fabric3"], colors=["00", "03", "05"]))


@registered("""p as (select model as entity, date_trunc('month', forecast_date)::date as day, sum(forecast) as forecast from fx_forecast where generated_date = date '2001-08-01' and forecast_date between date '2001-08-15' and date '2002-08-15' group by all),
    st as (select model as entity, sum(available_stock) as stock from fx_stock where snapshot_date = date '2001-08-13' group by all),
    x as (select entity, day as date, 1 as step, forecast as demand from p where entity in (select entity from st) union all select entity, date '2001-08-15', 0, 0 from st)
    select x.entity, x.date, step, demand::double as demand, stock - sum(demand) over (partition by entity order by date, step rows unbounded preceding)::double as projected from x join st using (entity)""")
def model_projection(spark, d):
    stock = inventory.by_model(inventory.latest_snapshot(fx.stock(spark, d))).select(F.col("model").alias("entity"), F.col("available_stock").alias("stock"), F.lit(0.0).alias("rop"))
    ahead = latest_forecast(spark, d).select(F.col("model").alias("entity"), "forecast_date", "forecast")
    return inventory.projection(stock, ahead, AS_OF).select("entity", "date", "step", "demand", "projected")


_LAGS = ", ".join(f"coalesce(lag(quantity, {k}) over w, 0) as lag_{k}" for k in series.LAGS)


@registered(f"""b as (select entity, min(month) as lo, max(month) as hi from months_model group by entity),
    g as (select entity, unnest(generate_series(lo, hi, interval 1 month))::date as month from b),
    s as (select g.entity, g.month, coalesce(quantity, 0) as quantity, 0 as step from g left join months_model m using (entity, month)),
    n as (select entity from s group by entity having count(*) >= 12), s1 as (select * from s where entity in (select entity from n)),
    e as (select entity, max(month) as hi, arg_max(quantity, month) as quantity from s1 group by entity),
    a as (select entity, (hi + to_months(cast(k as int)))::date as month, quantity, k as step from e, range(1, 7) t(k)),
    u as (select * from s1 union all select entity, month, quantity, step from a),
    l as (select *, {_LAGS} from u window w as (partition by entity order by month))
    select entity, month, step, {", ".join(f"lag_{k}" for k in series.LAGS)} from l where step > 0""", whole=" ".join(f"lag_{k}" for k in series.LAGS))
def future_lags(spark, d):
    lags = [f"lag_{k}" for k in series.LAGS]
    return series.future_matrix(months(spark, d), types(spark, d), 6).select("entity", "month", "step", *lags)


# Orders and allocation


@registered(_SUMMARY + """, al as (select * from (values ('01', 'XS'), ('02', 'S'), ('03', 'M'), ('04', 'L')) a(code, alias)),
    n as (select substring(entity, 1, 5) as model, coalesce(alias, substring(entity, 8, 2)) as name, sum(score) as score from pr left join al on code = substring(entity, 8, 2) group by all)
    select model, name, round(coalesce(score / nullif(max(score) over (partition by model), 0), 0), 6) as score from n""")
def size_scores(spark, d):
    return rounded(orders.size_scores(priority.prioritise(whole_summary(spark, d)), aliases(spark)))


@registered(_SUMMARY + """ select substring(entity, 6, 2) as color, round(avg(score), 6) as score, round(sum(deficit), 6) as deficit from pr
    where substring(entity, 1, 5) = (select min(model) from fx_model where bn = 5) group by color having bool_or(urgent)""")
def urgent_colors(spark, d):
    rolled = priority.by_model_color(priority.prioritise(whole_summary(spark, d)))
    return rounded(priority.urgent_colors(rolled, "CH005"))


@registered(_SUMMARY + """ select substring(entity, 1, 5) as model, substring(entity, 6, 2) as color, round(avg(score), 6) as score, round(sum(deficit), 6) as deficit, sum(forecast) as forecast,
    string_agg(substring(entity, 8, 2) || '=' || cast(floor(greatest(coalesce(deficit, 0), forecast)) as bigint), ',' order by substring(entity, 8, 2)) as sizes from pr group by all""", whole="forecast")
def color_items(spark, d):
    rows = orders.color_items(priority.prioritise(whole_summary(spark, d)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("sizes")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rounded(rows.withColumn("sizes", text))


@registered("""c as (select model, color, cast(sum(forecast) as double) as score from fx_forecast where generated_date = date '2001-08-01' group by all),
    m as (select substring(entity, 1, 5) as model, substring(entity, 6, 2) as color, sum(quantity) filter (where month = date '2001-06-01') as a, sum(quantity) filter (where month = date '2001-07-01') as b from months_sku group by all)
    select model, color, score, coalesce(a, 0) as "06-2001", coalesce(b, 0) as "07-2001" from c left join m using (model, color)""", whole='"06-2001" "07-2001"')
def order_table(spark, d):
    items = latest_forecast(spark, d).groupBy("model", "color").agg(F.sum("forecast").cast("double").alias("score"))
    return orders.order_table(items, months(spark, d, "sku"), [date(2001, 6, 1), date(2001, 7, 1)])


_MADE = "pd as (select model, color, size, bn * s % 7 as required, bn * c % 9 as produced from fx_sku)"


def made(spark, d):
    n = {k: F.col(k).cast("int") for k in ("color", "size")}
    return fx.skus(spark, d).select("model", "color", "size", (F.col("bn") * n["size"] % 7).alias("required"), (F.col("bn") * n["color"] % 9).alias("produced"))


@registered(_MADE + """, g as (select model, size, sum(required) as required, sum(produced) as produced from pd group by all),
    u as (select * from g union all select model, 'TOTAL', sum(required), sum(produced) from g where size not in ('06', '07') group by model) select *, produced - required as excess from u""", whole="required produced excess")
def required_and_produced(spark, d):
    return orders.required_and_produced(made(spark, d), ["06", "07"])


@registered(_MADE + ", z as (select model, color, size, sum(available_stock) as stock from fx_stock where snapshot_date = date '2001-08-13' group by all) select model, color, size, produced from pd join z using (model, color, size) where produced > 0 and stock = 0")
def produced_without_stock(spark, d):
    stock = inventory.latest_snapshot(fx.stock(spark, d)).groupBy("model", "color", "size").agg(F.sum("available_stock").alias("stock"))
    return orders.produced_without_stock(made(spark, d), stock)


@registered("""x as (select o_orderkey as id, timestamp '2001-01-01 00:00:00' + to_minutes(cast(o_custkey as bigint)) as a, timestamp '2001-01-01 00:30:00' + to_minutes(cast(o_orderkey % 4000 as bigint)) as b from orders),
    y as (select id, date_diff('second', a, b) as sec, cast(trunc(date_diff('second', a, b) / 60) as bigint) as minutes from x)
    select id, case when minutes < 0 then '' when minutes >= 1440 then cast(minutes // 1440 as varchar) || 'd' when minutes >= 60 then cast(minutes // 60 as varchar) || 'h' else '<1h' end as taken from y""")
def processing_times(spark, d):
    at = lambda text, minutes: F.timestamp_add("MINUTE", minutes, F.to_timestamp(F.lit(text)))
    rows = spark.read.parquet(f"{d}/orders.parquet")
    taken = orders.processing_time(at("2001-01-01 00:00:00", F.col("o_custkey").cast("int")), at("2001-01-01 00:30:00", (F.col("o_orderkey") % 4000).cast("int")))
    return rows.select(F.col("o_orderkey").alias("id"), taken.alias("taken"))


@registered("""m as (select model, bn, 100 + bn % 4 as weight, 'jersey ' || case bn % 3 when 0 then 'cotton rib' when 1 then 'cotton' else 'wool' end as name from fx_model),
    r as (select * from (values (1, 100, 'cotton rib'), (2, 100, 'wool'), (3, 101, 'cotton'), (4, 101, 'rib'), (5, 102, 'jersey wool')) t(rule_id, weight, name)),
    k as (select unnest(['cotton', 'rib', 'wool', 'jersey']) as k),
    o as (select m.model, rule_id, (select count(*) from k where contains(m.name, k.k)) as own, (select count(*) from k where contains(r.name, k.k)) as theirs, (select count(*) from k where contains(m.name, k.k) and contains(r.name, k.k)) as common
          from m join r using (weight)),
    p as (select model, rule_id, coalesce(common / nullif(greatest(own, theirs), 0), 0) as overlap from o) select model, rule_id, round(overlap, 6) as overlap from p qualify row_number() over (partition by model order by overlap desc, rule_id) = 1""")
def matched_constraints(spark, d):
    cloth = F.when(F.col("bn") % 3 == 0, "cotton rib").when(F.col("bn") % 3 == 1, "cotton").otherwise("wool")
    models = fx.models(spark, d).select("model", (100 + F.col("bn") % 4).alias("weight"), F.concat(F.lit("jersey "), cloth).alias("name"))
    rules = spark.createDataFrame([(1, 100, "cotton rib"), (2, 100, "wool"), (3, 101, "cotton"), (4, 101, "rib"), (5, 102, "jersey wool")], "rule_id int, weight int, name string")
    return rounded(materials.match_constraints(models, rules, ["cotton", "rib", "wool", "jersey"]))


@registered("""x as (select order_id, facility, case when facility in ('F1', 'F2') then 'Min ' || total_quantity % 9 || ' maks. ' || total_quantity % 50 || case when total_quantity % 2 = 0 then ' parzyste' else '' end when facility = 'F3' then ' n/d ' else '' end as t,
        total_quantity as q from fx_order)
    select order_id, case when facility in ('F1', 'F2') then q % 9 end as least, case when facility in ('F1', 'F2') then q % 50 end as most, case when facility in ('F1', 'F2') then q % 2 = 0 end as even,
           case when contains(lower(facility), 'f1') then q % 9 when contains(lower(facility), 'f2') then q % 50 else -1 end as chosen from x""")
def parsed_constraints(spark, d):
    q = F.col("total_quantity")
    text = F.concat(F.lit("Min "), q % 9, F.lit(" maks. "), q % 50, F.when(q % 2 == 0, " parzyste").otherwise(""))
    rows = fx.orders(spark, d).withColumn("t", F.when(F.col("facility").isin("F1", "F2"), text).when(F.col("facility") == "F3", " n/d ").otherwise(""))
    rows = rows.withColumn("c", materials.parse_constraint(F.col("t")))
    chosen = materials.facility_column(F.col("facility"), {"f1": F.col("c.least"), "F2": F.col("c.most")}, F.lit(-1))
    return rows.select("order_id", "c.least", "c.most", "c.even", chosen.alias("chosen"))


_DEMAND = """dm as (select model, color, size, cast(bn * 3 + c * 5 + s as bigint) as quantity from fx_sku),
    hs as (select model, color, size, sum(quantity) as sold from fx_history where color <> '03' group by all)"""


def demand(spark, d):
    n = {k: F.col(k).cast("int") for k in ("color", "size")}
    return fx.skus(spark, d).select("model", "color", "size", (F.col("bn") * 3 + n["color"] * 5 + n["size"]).cast("long").alias("quantity"))


@registered(_DEMAND + " select model, color, size, quantity from dm left join hs using (model, color, size) where coalesce(sold >= 40, true)")
def demand_without_slow_sizes(spark, d):
    sold = fx.history(spark, d).where("color <> '03'").groupBy("model", "color", "size").agg(F.sum("quantity").alias("sold"))
    return allocation.drop_slow_sizes(demand(spark, d), sold, 40)


@registered(_DEMAND + """, tg as (select model, color, 50 + cast(color as int) * 3 as target from dm group by all),
    x as (select *, quantity * (target / sum(quantity) over (partition by model, color)) as v from dm join tg using (model, color))
    select model, color, size, quantity, greatest(1, cast(round_even(v, 0) as bigint)) as scaled from x""")
def scaled_sizes(spark, d):
    targets = demand(spark, d).groupBy("model", "color").agg((50 + F.max(F.col("color").cast("int")) * 3).alias("target"))
    return allocation.scale_to_target(demand(spark, d), targets)


_USES = "us as (select model, color, s as pattern_id, cast(bn * c * s % 11 as bigint) as uses from fx_sku)"


def uses(spark, d):
    n = {k: F.col(k).cast("int") for k in ("color", "size")}
    return fx.skus(spark, d).select("model", "color", n["size"].alias("pattern_id"), (F.col("bn") * n["color"] * n["size"] % 11).cast("long").alias("uses"))


@registered(_USES + """, t as (select *, sum(uses) over (partition by model, pattern_id) as total, sum(uses) over (partition by model, pattern_id order by color rows unbounded preceding) as until from us),
    g as (select *, case when total = 0 then 0 when total < 30 then 30 when total > 40 then 40 else total end as goal from t)
    select model, color, pattern_id, cast(coalesce((until * goal) // nullif(total, 0), 0) - coalesce(((until - uses) * goal) // nullif(total, 0), 0) as bigint) as uses from g""")
def uses_within_material(spark, d):
    return allocation.material_bounds(uses(spark, d), 30, 40)


@registered(_USES + " select model, color, pattern_id, uses + uses % 2 as uses from us")
def even_uses(spark, d):
    return allocation.parity(uses(spark, d))


@registered(_USES + " select * from us where uses > 0 and uses < 5")
def uses_under_the_least(spark, d):
    return allocation.violations(uses(spark, d), 5)


@registered("""c as (select model, color, sum(quantity) as q from fx_history group by all), z as (select model, size, sum(quantity) as q from fx_history group by all), t as (select model, 100 + bn as total from fx_model),
    cs as (select *, q / sum(q) over (partition by model) as c from c), zs as (select *, q / sum(q) over (partition by model) as s from z)
    select model, color, size, cast(round_even(total * c * s, 0) as bigint) as quantity from t join cs using (model) join zs using (model)""")
def childrens_shares(spark, d):
    h = fx.history(spark, d)
    by = lambda k: h.groupBy("model", k).agg(F.sum("quantity").alias("quantity"))
    return allocation.children_shares(fx.models(spark, d).select("model", (100 + F.col("bn")).alias("total")), by("color"), by("size"))


@registered(_USES + ", pt as (select i as pattern_id, lpad(cast(unnest([i, i + 1]) as varchar), 2, '0') as size from range(1, 5) t(i)) select pattern_id, pt.size, sum(uses) filter (where color = '01') as \"01\", sum(uses) filter (where color = '02') as \"02\" from us join pt using (pattern_id) where model = 'CH005' group by pattern_id, pt.size", whole='"01" "02"')
def production_table(spark, d):
    patterns = spark.createDataFrame([(i, f"{s:02d}", 1) for i in range(1, 5) for s in (i, i + 1)], "pattern_id int, size string, count int")
    return allocation.production_table(uses(spark, d), patterns, "CH005", ["01", "02"])


@registered("""i as (select distinct order_id from fx_order where total_quantity % 5 = 0)
    select order_id, case when order_id in (select order_id from i) then 'archived' else status end as status, case when order_id in (select order_id from i) then timestamp '2001-08-15 10:00:00' end as archived_at from fx_order""")
def archived_after_delivery(spark, d):
    rows = fx.orders(spark, d).withColumn("archived_at", F.lit(None).cast("timestamp"))
    at = F.to_timestamp(F.lit("2001-08-15 10:00:00"))
    return orders.archive(rows, rows.where("total_quantity % 5 = 0"), at).select("order_id", "status", "archived_at")


@registered("select order_id, model, 'active' as status, facility, cast(null as varchar) as operation, cast(null as varchar) as material from fx_order where total_quantity > 200")
def manual_orders(spark, d):
    rows = fx.orders(spark, d).where("total_quantity > 200").select("order_id", "model", "facility")
    return orders.manual_order(rows, AS_OF).select("order_id", "model", "status", "facility", "operation", "material")


# Forecast stores


@registered("""f as (select model as entity, forecast_date as month, sum(forecast)::double as forecast from fx_forecast where generated_date = date '2001-08-01' group by all),
    t as (select sku, model, sum(quantity) as q from fx_history group by all), s as (select *, q / sum(q) over (partition by model) as share from t)
    select sku, month as forecast_date, round(forecast * share, 6) as forecast from f join s on model = entity""")
def vendor_rows_of_model_forecasts(spark, d):
    forecasts = latest_forecast(spark, d).groupBy(F.col("model").alias("entity"), F.col("forecast_date").alias("month")).agg(F.sum("forecast").cast("double").alias("forecast"))
    sold = fx.history(spark, d).groupBy("model", "sku").agg(F.sum("quantity").alias("q"))
    whole = sold.groupBy("model").agg(F.sum("q").alias("whole"))
    shares = sold.join(whole, "model").select("model", "sku", (F.col("q") / F.col("whole")).alias("share"))
    return rounded(forecasting.as_vendor_rows(forecasts, shares))


@registered(_SUMMARY + " select entity, round(rop, 6) as rop, stock from p where upper(entity) like '%CH0%'", whole="stock")
def summary_details(spark, d):
    return rounded(accuracy.details(whole_summary(spark, d), search="ch0", by="rop", descending=True).select("entity", "rop", "stock"))


@registered(_SUMMARY + """ select pr.entity, main_material_name as material, 'F' || cast(substring(pr.entity, 3, 3) as int) % 4 as facility from pr join fx_bom b on b.model = substring(pr.entity, 1, 5)
    where cast(substring(pr.entity, 3, 3) as int) % 4 in (1, 2) and main_material_name <> 'fabric1'""")
def summary_of_facilities(spark, d):
    rows = whole_summary(spark, d).withColumn("facility", F.concat(F.lit("F"), F.expr("cast(substring(entity, 3, 3) as int) % 4")))
    rows = rows.where(inventory.matches(facilities=["F1", "F2"], not_materials=["fabric1"])).where("material is not null")
    return rows.select("entity", "material", "facility")


@registered("""select (select min(model) from fx_model) as least, count(*) as n from fx_sales""")
def sales_through_views(spark, d):
    from replen.operators import adhoc

    adhoc.register(spark, {"replen_sales": fx.sales(spark, d), "replen_models": fx.models(spark, d)})
    return spark.sql("select (select min(model) from replen_models) as least, count(*) as n from replen_sales")


@registered("m as (select p_name as name, p_brand as method, p_retailprice as cv_score from part) select count(*) as n, round(avg(cv_score), 6) as mean_score, (select method from m group by method order by count(*) desc, method limit 1) as most_common from m")
def model_registry_kpis(spark, d):
    from replen.operators import store

    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name"), F.col("p_brand").alias("method"), F.col("p_retailprice").alias("cv_score"))
    return rounded(store.model_kpis(rows))


@registered(_SUMMARY + " select type, count(*) as n from k group by type")
def type_counts(spark, d):
    return plans.reorder_points(fx.sales(spark, d), "sku", AS_OF).groupBy("type").agg(F.count("*").alias("n"))


# Feeds as they come

_FILES = """fl as (select order_id, year(order_date) as y, order_date, case when cast(order_id as bigint) % 3 = 0 then year(order_date) || '0101-' || year(order_date) || '0630.csv'
        when cast(order_id as bigint) % 3 = 1 then year(order_date) || '0101-' || year(order_date) || '1231.csv' else 'notes.csv' end as source_file from fx_order)"""


def dated_files(spark, d):
    y, k = F.year("order_date").cast("string"), F.col("order_id").cast("long") % 3
    name = F.when(k == 0, F.concat(y, F.lit("0101-"), y, F.lit("0630.csv"))).when(k == 1, F.concat(y, F.lit("0101-"), y, F.lit("1231.csv"))).otherwise("notes.csv")
    rows = fx.orders(spark, d).withColumn("source_file", name)
    start, end = files.span_in_name(F.col("source_file"))
    return rows.withColumns({"file_start": start, "file_end": end})


@registered(_FILES + " select order_id, source_file from fl where source_file like '%1231.csv'")
def cumulative_files(spark, d):
    return files.best_file_per_year(dated_files(spark, d)).select("order_id", "source_file")


@registered(_FILES + " select order_id, source_file from fl where source_file = '19971231.csv' or source_file = '19970101-19971231.csv'")
def files_of_1997(spark, d):
    return files.current_year_file(dated_files(spark, d), date(1997, 6, 1)).select("order_id", "source_file")


@registered("""l as (select distinct facility, year(order_date) as y, month(order_date) as m from fx_order),
    x as (select '/in/' || facility || '/' || y || '0101-' || (y + m % 2) || lpad(cast(m as varchar), 2, '0') || '28.csv' as path, make_date(y, 1, 1) as s, make_date(y + m % 2, m, 28) as e from l where m <> 12),
    r as (select *, row_number() over (partition by year(e) order by e - s desc, e desc, path) as k from x)
    select path, s as file_start, e as file_end from r where k = 1""")
def chosen_sales_files(spark, d):
    y, m = F.year("order_date"), F.month("order_date")
    name = F.concat(y.cast("string"), F.lit("0101-"), (y + m % 2).cast("string"), F.lpad(m.cast("string"), 2, "0"), F.when(m == 12, "99.csv").otherwise("28.csv"))
    found = fx.orders(spark, d).select("facility", name.alias("name")).distinct().withColumn("path", F.concat_ws("/", F.lit("/in"), "facility", "name"))
    return discovery.best_per_year(discovery.sales_files(found)).select("path", "file_start", "file_end")


@registered("""l as (select distinct order_date, cast(order_id as bigint) % 3 as k from fx_order),
    r as (select order_date, k, row_number() over (partition by order_date order by k = 0, k desc) as n from l where k < 2)
    select order_date as generated_date, '/fc/' || order_date || '/forecast_' || k || case when k = 0 then '.csv' else '.xlsx' end as path from r where n = 1""")
def chosen_forecast_versions(spark, d):
    k = F.col("order_id").cast("long") % 3
    name = F.concat(F.when(k == 2, "notes_").otherwise("forecast_"), k.cast("string"), F.when(k == 0, ".csv").otherwise(".xlsx"))
    found = fx.orders(spark, d).select(F.col("order_date").cast("string").alias("day"), name.alias("name")).distinct()
    found = found.withColumn("path", F.concat_ws("/", F.lit("/fc"), "day", "name"))
    return discovery.forecast_files(found).select("generated_date", "path")


_INTERVALS = """dn as (select snapshot_date, row_number() over (order by snapshot_date) as n from (select distinct snapshot_date from fx_stock)),
    hs as (select sku, snapshot_date, n, max(available_stock) as stock from fx_stock join dn using (snapshot_date) group by all),
    ho as (select *, stock is distinct from lag(stock) over w or n is distinct from lag(n) over w + 1 as starts from hs window w as (partition by sku order by n)),
    hr as (select *, sum(starts::int) over (partition by sku order by n) as run from ho)
    select sku, min(snapshot_date) as first, max(snapshot_date) as last, min(stock)::bigint as stock from hr group by sku, run"""


def _snapshots(spark, d):
    return fx.stock(spark, d).select("sku", "snapshot_date", "available_stock")


def _as_whole(found):
    return found.select("sku", "first", "last", F.col("stock").cast("long").alias("stock"))


@registered(_INTERVALS)
def intervals_of_stock(spark, d):
    return _as_whole(stock_intervals.intervals(_snapshots(spark, d)))


@registered(_INTERVALS)
def intervals_after_late_snapshots(spark, d):
    rows = _snapshots(spark, d)
    early = rows.where("day(snapshot_date) % 3 <> 0")
    found, days = stock_intervals.extend(stock_intervals.intervals(early), stock_intervals.snapshot_days(early), rows)
    return _as_whole(found)


def _runs(spark, d, entity):
    rows = _snapshots(spark, d)
    days = stock_intervals.snapshot_days(rows)
    return stock_intervals.entity_runs(stock_intervals.intervals(rows), days, entity), days


@registered()
def streaks_from_intervals(spark, d):
    return stock_intervals.out_of_stock_streaks(*_runs(spark, d, F.col("sku")))


@registered()
def accuracy_from_intervals(spark, d):
    runs, days = _runs(spark, d, F.substring("sku", 1, 5))
    grid = stock_intervals.daily_grid(fx.sales(spark, d), fx.forecast_daily(spark, d), runs, days, date(2001, 5, 16), date(2001, 7, 30), "model")
    return rounded(accuracy.accuracy(grid))


ORACLE["streaks_from_intervals"], ORACLE["accuracy_from_intervals"] = ORACLE["out_of_stock_streaks"], ORACLE["forecast_accuracy"]


@registered("x as (select sku, snapshot_date, max(available_stock) as available_stock from fx_stock where day(snapshot_date) % 2 = 0 group by all) select * from x")
def unseen_snapshots(spark, d):
    stock = fx.stock(spark, d)
    return files.new_snapshots(stock.unionByName(stock), stock.where("day(snapshot_date) % 2 = 1"))


@registered("""x as (select upper(model) as model, case when bn % 3 = 0 then 0 else bn + 0.5 end::double as weight, case when bn % 4 = 1 then 'Cotton ' || bn end as name, bn % 5 in (0, 1) as outlet from fx_model) select * from x""")
def bom_as_written(spark, d):
    bn = F.col("bn")
    raw = fx.models(spark, d).select(
        F.concat(F.lit(" "), F.lower("model")).alias("model"), F.when(bn % 3 == 0, "n/a").otherwise(F.concat(bn.cast("string"), F.lit(",5"))).alias("weight"),
        F.when(bn % 4 == 1, F.concat(F.lit(" Cotton "), bn.cast("string"))).when(bn % 4 == 2, " brak ").when(bn % 4 == 3, "-").otherwise("").alias("name"),
        F.when(bn % 5 == 0, " TAK").when(bn % 5 == 1, "x").when(bn % 5 == 2, "nie").alias("outlet"),
    )
    return files.normalised_bom(raw.unionByName(raw).unionByName(raw.limit(1).withColumn("model", F.lit("  "))), ["weight"], ["name"], ["outlet"])


@registered("x as (select distinct size as code, 'S' || s as alias from fx_sku) select * from x")
def size_codes(spark, d):
    rows = fx.skus(spark, d).select(F.col("size").cast("int").alias("code"), F.concat(F.lit(" S"), F.col("size").cast("int").cast("string")).alias("alias"))
    return files.size_aliases(rows.distinct())


@registered("x as (select distinct case when c = 3 then '0A' else color end as code, 'c' || color as alias from fx_sku) select * from x")
def color_codes(spark, d):
    n = F.col("color").cast("int")
    raw = F.when(n == 3, "a").when(n == 4, "**04*").otherwise(n.cast("string"))
    return files.color_aliases(fx.skus(spark, d).select(raw.alias("code"), F.concat(F.lit("c"), "color", F.lit(" ")).alias("alias")).distinct())


@registered("x as (select distinct model from fx_model where bn % 3 = 2) select * from x")
def outlet_models_of_the_last_year(spark, d):
    name = F.concat(F.lit("outlet_"), (F.lit(2019) + F.col("bn") % 3).cast("string"), F.lit(".csv"))
    raw = fx.skus(spark, d).select(F.col("sku").alias("Model"), name.alias("source_file")).unionByName(fx.models(spark, d).select(F.col("model").alias("Model"), name.alias("source_file")))
    return files.newest_outlets(raw.unionByName(raw.limit(5).withColumn("source_file", F.lit("outlet.csv"))))


@registered(_SUMMARY.split(",\n        st as")[0].replace("_sku", "_model") + """, b as (select entity, date_diff('month', min(month), max(month)) + 1 as n from months_model group by entity),
    x as (select k.entity, case when type = 'new' or n < 12 then 'moving_avg' when cv < 0.6 then 'exp_smoothing' when n >= 24 and (cv is not null or type in ('regular', 'seasonal')) then 'holt_winters' else 'exp_smoothing' end as method from k join b using (entity))
    select method, count(*) as n_entities from x group by method""")
def method_counts(spark, d):
    n = series.filled(months(spark, d)).groupBy("entity").agg(F.count("*").alias("n"))
    rows = types(spark, d).join(n, "entity").withColumn("method", forecasting.choose_method(F.col("type"), F.col("cv"), F.col("n")))
    return rows.groupBy("method").agg(F.count("*").alias("n_entities"))


@registered(f"""b as (select entity, min(month) as lo, max(month) as hi from months_model group by entity),
    g as (select entity, unnest(generate_series(lo, hi, interval 1 month))::date as month from b),
    s as (select g.entity, g.month, coalesce(quantity, 0) as quantity from g left join months_model m using (entity, month)),
    n as (select entity from s group by entity having count(*) >= 12),
    l as (select *, {", ".join(f"lag(quantity, {k}) over w as lag_{k}" for k in series.LAGS)} from s where entity in (select entity from n) window w as (partition by entity order by month))
    select entity, month, quantity, {", ".join(f"lag_{k}" for k in series.LAGS)} from l where lag_12 is not null""", whole="quantity " + " ".join(f"lag_{k}" for k in series.LAGS))
def training_lags(spark, d):
    return series.training_matrix(months(spark, d), types(spark, d)).select("entity", "month", "quantity", *[f"lag_{k}" for k in series.LAGS])


@registered(_FILLED + """, nm as (select *, row_number() over (partition by entity order by month) - 1 as pos, count(*) over (partition by entity) as n from fs),
    ct as (select distinct entity, n, fold, n - (3 - fold) * 3 as cut from nm, range(0, 3) f(fold)),
    ok as (select * from ct where cut >= greatest(12, n - 12)),
    pr as (select ok.entity, fold, cut, sum(quantity * case cut - pos when 3 then 0.5 when 2 then 0.3 else 0.2 end::double) as f from ok join nm on nm.entity = ok.entity and pos >= cut - 3 and pos < cut group by all),
    er as (select pr.entity, fold, avg(case when quantity <> 0 then abs(f - quantity) / abs(quantity) end) * 100 as mape, avg(2 * abs(f - quantity) / nullif(abs(f) + abs(quantity), 0)) * 100 as smape,
                  avg(abs(f - quantity)) as mae, sqrt(avg((f - quantity) * (f - quantity))) as rmse
           from pr join nm on nm.entity = pr.entity and pos >= cut and pos < cut + 3 group by all)
    select entity, 'moving_avg' as method, round(avg(mape), 6) as mape, round(avg(smape), 6) as smape, round(avg(mae), 6) as mae, round(avg(rmse), 6) as rmse from er group by entity""")
def moving_average_cross_validation(spark, d):
    return rounded(forecasting.cross_validate(series.filled(months(spark, d), 12), methods=("moving_avg",)))


_ROWS = _FILLED + """, lg as (select *, lag(quantity, 1) over w as lag_1, lag(quantity, 12) over w as lag_12 from fs window w as (partition by entity order by month)),
    tr as (select *, count(*) over (partition by entity) as n, row_number() over (partition by entity order by month desc) - 1 as back from lg where lag_12 is not null),
    fo as (select *, case when back // 3 < 3 and n - (back // 3 + 1) * 3 >= 12 then 2 - back // 3 end as fold from tr)"""


@registered(_ROWS + """ select entity, fold, count(*) as n, sum(quantity) as sum_quantity, sum(lag_1 * quantity) as lag_1_quantity, sum(lag_1 * lag_12) as lag_1_lag_12,
    sum(quantity * quantity) as quantity_quantity from fo group by entity, fold""", whole="n sum_quantity lag_1_quantity lag_1_lag_12 quantity_quantity")
def training_sums_by_fold(spark, d):
    """Entries of the mergeable sums of products that linear models of each entity are solved from."""
    rows = entity_models.with_folds(series.training_matrix(months(spark, d), types(spark, d)))
    at = {pair: k for k, pair in enumerate(entity_models.UPPER)}
    y, one, twelve = entity_models.WIDE - 1, 1, 1 + forecasting.FEATURES.index("lag_12")
    taken = {"n": (0, 0), "sum_quantity": (0, y), "lag_1_quantity": (one, y), "lag_1_lag_12": (one, twelve), "quantity_quantity": (y, y)}
    return entity_models.gram_sums(rows).select("entity", "fold", *[F.col("gram")[at[p]].cast("long").alias(c) for c, p in taken.items()])


def kept_months(spark, d):
    """Months and types of models, for which the sales are read once."""
    known = entity_models.kept(months(spark, d))
    return known, entity_models.kept(stats.classify(stats.entity_stats(known), AS_OF))


@registered()
def entity_model_scores(spark, d):
    return rounded(entity_models.model_scores(entity_models.out_of_fold(*kept_months(spark, d))))


@registered()
def entity_model_forecasts(spark, d):
    return rounded(entity_models.train_and_forecast(*kept_months(spark, d), 3)[0])


@registered(_FILLED + """, nm as (select *, row_number() over (partition by entity order by month) - 1 as pos, count(*) over (partition by entity) as n from fs),
    ct as (select distinct entity, n, fold, n - (3 - fold) * 3 as cut from nm, range(0, 3) f(fold)),
    ok as (select * from ct where cut >= greatest(12, n - 12)),
    pr as (select ok.entity, fold, cut, sum(quantity * case cut - pos when 3 then 0.5 when 2 then 0.3 else 0.2 end::double) as f from ok join nm on nm.entity = ok.entity and pos >= cut - 3 and pos < cut group by all),
    er as (select pr.entity, fold, avg(abs(f - quantity)) as mae from pr join nm on nm.entity = pr.entity and pos >= cut and pos < cut + 3 group by all),
    sc as (select entity, avg(mae) as score from er group by entity)
    select coalesce(case when score is not null then 'moving_avg' end, 'failed') as method, count(*) as n_entities, round(avg(score), 6) as mean_score
    from (select distinct entity from months_model) left join sc using (entity) group by 1""")
def training_summary_of_moving_averages(spark, d):
    found, kinds = kept_months(spark, d)
    known = entity_models.out_of_fold(found, kinds, candidates=("moving_avg",))
    best = entity_models.best_models(entity_models.model_scores(known, "mae"))
    return rounded(entity_models.training_summary(found, best))


# States that batches add to

_STATE = "count(*) as n_rows, count(v) as n, round(coalesce(sum(v), 0), 4) as total, round(coalesce(var_pop(v) * count(v), 0), 4) as m2, min(v) as low, max(v) as high, min(tm)::date as first_day, max(tm)::date as last_day"


def state_rows(df):
    days = [F.col(c).cast("date").alias(f"{c}_day") for c in ("first", "last")]
    return rounded(df.select(*states.KEYS, "n_rows", "n", "total", "m2", "low", "high", *days), 4)


def sales_states(rows, by=()):
    return states.month_states(rows, {"sku": F.col("sku"), "model": F.col("model")}, F.col("sale_date"), F.col("quantity"), by)


@registered(f"""s as (select 'sku' as entity_type, sku as entity_id, sale_date as tm, quantity::double as v from fx_sales union all select 'model', model, sale_date, quantity::double from fx_sales)
    select entity_type, entity_id, date_trunc('month', tm)::date as month, {_STATE} from s group by all""")
def merged_sales_states(spark, d):
    """States of ten batches of all sales, merged; the same as the states of all sales at once."""
    rows = fx.sales(spark, d).withColumn("batch", F.pmod(F.hash("order_id"), F.lit(10)))
    return state_rows(states.merged(sales_states(rows, ("batch",)).drop("batch")))


@registered(f"""s as (select 'user' as entity_type, user_id::varchar as entity_id, ts as tm, value as v from events union all select 'event_type', event_type, ts, value from events)
    select entity_type, entity_id, date_trunc('month', tm)::date as month, {_STATE} from s group by all""")
def merged_event_states(spark, d):
    """States of the days of all events, merged into months."""
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("day", F.to_date("ts"))
    made = states.month_states(rows, {"user": F.col("user_id"), "event_type": F.col("event_type")}, F.col("ts"), F.col("value"), ("day",))
    return state_rows(states.merged(made.drop("day")))


@registered("""s as (select 'sku' as entity_type, sku as entity_id, sale_date, quantity from fx_sales union all select 'model', model, sale_date, quantity from fx_sales),
    m as (select entity_type, entity_id, sum(quantity) as quantity, min(sale_date) as first_sale from s group by entity_type, entity_id, date_trunc('month', sale_date))
    select entity_type, entity_id, count(*) as n_months, round(sum(quantity)::double, 6) as quantity, round(avg(quantity), 6) as average, round(stddev_samp(quantity), 6) as sd, min(first_sale) as first_sale,
           round(coalesce(stddev_samp(quantity) / nullif(avg(quantity), 0), 0), 6) as cv from m group by all""")
def stats_refreshed_from_states(spark, d):
    """Statistics after the sales of August came as a batch: those of the entities it touches, from merged states; the others as they were."""
    sales = fx.sales(spark, d)
    before, batch = sales_states(sales.where("sale_date < date '2001-08-01'")), sales_states(sales.where("sale_date >= date '2001-08-01'"))
    return rounded(states.refreshed_table(states.entity_table(before), states.merged(before.unionByName(batch)), batch))


# Smoothing with stated parameters; SQL steps through the months by recursion


@registered(_FILLED + """, nm as (select entity, quantity::double as v, row_number() over (partition by entity order by month) as k from fs),
    rs as (with recursive r as (
        select a.entity, 1 as k, a.v as level, b.v - a.v as trend, 0::double as sse from nm a join nm b on a.entity = b.entity and a.k = 1 and b.k = 2
        union all
        select r.entity, r.k + 1, 0.3 * v + 0.7 * (level + trend), 0.1 * (0.3 * v + 0.7 * (level + trend) - level) + 0.9 * trend, sse + (v - level - trend) * (v - level - trend)
        from r join nm on nm.entity = r.entity and nm.k = r.k + 1) select * from r)
    select entity, round(arg_max(level, k), 4) as level, round(arg_max(trend, k), 4) as trend, round(arg_max(sse, k), 2) as sse from rs group by entity""")
def smoothing_of_stated_parameters(spark, d):
    arrays = forecasting.as_arrays(series.filled(months(spark, d), 12))
    rows = arrays.select("entity", forecasting.smoothing_fit(F.col("y"), 0.3, 0.1).alias("fit")).select("entity", "fit.*")
    return rows.select("entity", F.round("level", 4).alias("level"), F.round("trend", 4).alias("trend"), F.round("sse", 2).alias("sse"))
