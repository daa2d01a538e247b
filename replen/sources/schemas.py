"""Canonical schemas of the feeds, as DDL that readers take."""

SALES = "order_id string, sale_date date, sku string, quantity int, unit_price double, total_amount double"
STOCK = "sku string, product_name string, net_price double, gross_price double, total_stock double, available_stock double, is_active int"
FORECAST = "forecast_date date, sku string, forecast double"
CATEGORY = "model string, grupa string, podgrupa string, kategoria string, nazwa string"
BOM = "model string, main_material_name string, main_m double, main_kg double, ribbing_type string, ribbing_m double, lining_m double"
PATTERN_SETS = (
    "id int, name string, size_names array<string>, min_order_per_pattern int, patterns array<struct<id: int, name: string, sizes: map<string, int>>>"
)
