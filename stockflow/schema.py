"""Table schemas and the headings under which existing tables carry them."""

from __future__ import annotations

ITEM_KEYS = ["item_code", "warehouse"]
MONTH_KEYS = ["item_code", "warehouse", "year", "month"]
DAY_KEYS = ["item_code", "warehouse", "dt"]
LOAD_ORDER = ["src_file", "src_row"]

MONTHLY = """
    item_code string, warehouse string, year int, month int, item_name string, manufacturer string,
    total_sold double, total_restocked double, sale_days bigint, avg_price double,
    in_stock_days bigint, last_stock double, distinct_days bigint, turnover double,
    min_price double, max_price double, open_price double, close_price double,
    price_change_abs double, price_change_pct double
"""

TOTALS = """
    item_code string, warehouse string, item_name string, manufacturer string,
    total_sold double, total_restocked double, sale_days bigint, avg_price double,
    min_price double, max_price double, open_price double, close_price double,
    in_stock_days bigint, turnover double
"""

SPIKES = MONTHLY + ", month_start date, trailing_avg double, is_spike boolean"

ENRICHED_DAILY = """
    warehouse string, item_key string, dt timestamp_ntz, stock double, price double,
    item_name string, canonical_name string,
    sold double, restocked double, price_changed boolean, is_anomaly boolean
"""

# Defaults of the monthly measures a table may lack: counts and sums become 0, prices stay missing.
MONTHLY_DEFAULTS = {
    "total_sold": ("double", 0.0),
    "total_restocked": ("double", 0.0),
    "sale_days": ("bigint", 0),
    "avg_price": ("double", None),
    "min_price": ("double", None),
    "max_price": ("double", None),
    "open_price": ("double", None),
    "close_price": ("double", None),
    "in_stock_days": ("bigint", 0),
}

NAME_DEFAULTS = {"item_code": ("string", ""), "item_name": ("string", ""), "warehouse": ("string", "")}

DAILY_DEFAULTS = {
    "warehouse": ("string", ""),
    "item_key": ("string", ""),
    "dt": ("timestamp_ntz", None),
    "stock": ("double", 0.0),
    "price": ("double", 0.0),
    "item_name": ("string", ""),
    "canonical_name": ("string", ""),
}

# The headings of tables users already have, and our names for them.
HEADINGS = {
    "Дата": "dt",
    "Артикул": "item_code",
    "Номенклатура": "item_name",
    "Склад": "warehouse",
    "Количество": "stock",
    "Остаток": "stock",
    "Цена": "price",
    "Производитель": "manufacturer",
    "Год": "year",
    "Месяц": "month",
    "Продано": "sold",
    "Пополнение": "restocked",
    "Пришло": "restocked",
    "Склад_откуда": "from_warehouse",
    "Склад_куда": "to_warehouse",
    "Кол-во": "qty",
    "Всего_продано": "total_sold",
    "Всего_пополнено": "total_restocked",
    "Дней_продаж": "sale_days",
    "Дней_в_наличии": "in_stock_days",
    "Уникальных_дней": "distinct_days",
    "Последний_остаток": "last_stock",
    "Средняя_цена": "avg_price",
    "Мин_цена": "min_price",
    "Макс_цена": "max_price",
    "Цена_в_начале": "open_price",
    "Цена_в_конце": "close_price",
    "Изменение_цены_абс": "price_change_abs",
    "Изменение_цены_%": "price_change_pct",
    "Оборачиваемость": "turnover",
    "Средний_остаток": "avg_stock",
    "Артикул_норм": "item_code_norm",
    "Номенклатура_норм": "item_name_norm",
    "Среднее_последних_месяцев": "trailing_avg",
    "Всплеск": "is_spike",
    "Артикул_товар": "item_key",
    "Номенклатура_канон": "canonical_name",
    "Номенклатура_варианты": "name_variants",
    "Смена_наименования": "name_changed",
    "Цена_изменилась": "price_changed",
    "Аномалия": "is_anomaly",
}

# Loose headings of a monthly table, unified before use.
MONTHLY_ALIASES = {
    "Количество": "total_sold",
    "Продано": "total_sold",
    "Всего продано": "total_sold",
    "Пополнено": "total_restocked",
    "Дни продаж": "sale_days",
    "Дней продаж": "sale_days",
    "Цена в начале": "open_price",
    "Цена в конце": "close_price",
    "Дни в наличии": "in_stock_days",
}
