"""The same queries in SQL, written independently of the operators."""

from __future__ import annotations

import re

ORDER = "load_rank"
LINE = "l_orderkey, l_linenumber, l_extendedprice"
SERIES = "partition by item_code, warehouse order by dt"

# White space at the ends of a cell, as code points.
_WS_POINTS = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
WS = " || ".join(f"chr({p})" for p in _WS_POINTS)


def _first(column: str, order: str) -> str:
    return f"first({column} order by {order}) filter (where {column} is not null) as {column}"


def _rint(expression: str, places: int) -> str:
    scale = f"{10**places}.0"
    return f"round_even(({expression}) * {scale}, 0) / {scale}"


# Common table expressions by name. A query lists what it reads simply by naming it.
PARTS = {
    "snap": """
        select l_shipdate as dt,
          'it-' || lpad(cast(l_partkey // 20 as varchar), 6, '0') as item_code,
          case l_suppkey % 5 when 0 then 'WH-A' when 1 then 'WH-N' when 2 then 'WH-R'
               else 'WH-' || cast(l_suppkey // 50 as varchar) end as warehouse,
          case when (l_partkey // 20) % 10 = 9 then 5.0
               when l_quantity = 50 then null else l_quantity - 1 end as stock,
          case when l_tax = 0.08 and l_linenumber = 2 then 0.0
               when l_tax = 0.08 and l_linenumber = 1 then null
               else round(100 * (1 - l_discount), 2) end as price,
          case when l_linenumber = 7 then '  ' || upper(p_name) || ' дефект' else p_name end as item_name,
          p_brand as manufacturer,
          l_orderkey, l_linenumber, l_extendedprice, l_suppkey, l_tax,
          ((l_orderkey * 8 + l_linenumber) * 32 + l_partkey % 20) * 32768 + l_suppkey % 32768 as load_rank
        from lineitem join part on l_partkey = p_partkey""",
    "daily": f"""
        select item_code, warehouse, dt, {_first('stock', ORDER)}, {_first('price', ORDER)},
          {_first('item_name', ORDER)}, {_first('manufacturer', ORDER)}
        from snap group by item_code, warehouse, dt""",
    "dated": "select *, cast(year(dt) as integer) as year, cast(month(dt) as integer) as month from daily",
    "moved": f"""
        select *, coalesce(stock - lag(stock) over ({SERIES}), 0.0) as stock_diff from dated""",
    "flows": """
        select *, greatest(-stock_diff, 0.0) + 0.0 as sold, greatest(stock_diff, 0.0) + 0.0 as restocked
        from moved""",
    "transfers": """
        select a.dt, a.item_code, b.warehouse as from_warehouse, a.warehouse as to_warehouse,
          a.stock_diff as qty
        from flows a join flows b
          on a.dt = b.dt and a.item_code = b.item_code and a.stock_diff = -b.stock_diff
        where a.stock_diff > 0 and b.stock_diff < 0 and a.warehouse <> b.warehouse""",
    "net": """
        select f.* replace (
          case when o.dt is null then f.sold else 0.0 end as sold,
          case when i.dt is null then f.restocked else 0.0 end as restocked)
        from flows f
        left join (select distinct dt, item_code, from_warehouse as warehouse from transfers) o
          on f.dt = o.dt and f.item_code = o.item_code and f.warehouse = o.warehouse
        left join (select distinct dt, item_code, to_warehouse as warehouse from transfers) i
          on f.dt = i.dt and f.item_code = i.item_code and f.warehouse = i.warehouse""",
    "open_close": """
        select item_code, warehouse, year, month,
          first(price order by dt) filter (where price is not null) as open_price,
          last(price order by dt) filter (where price is not null) as close_price
        from dated group by item_code, warehouse, year, month""",
    "month_sums": """
        select item_code, warehouse, year, month,
          first(item_name order by dt) filter (where item_name is not null) as item_name,
          first(manufacturer order by dt) filter (where manufacturer is not null) as manufacturer,
          coalesce(sum(sold), 0.0) as total_sold, coalesce(sum(restocked), 0.0) as total_restocked,
          cast(count(*) filter (where sold > 0) as bigint) as sale_days,
          avg(price) as avg_price,
          cast(count(*) filter (where stock > 0) as bigint) as in_stock_days,
          last(stock order by dt) filter (where stock is not null) as last_stock,
          cast(count(distinct dt) as bigint) as distinct_days,
          min(price) as min_price, max(price) as max_price
        from net group by item_code, warehouse, year, month""",
    "monthly": """
        select s.item_code, s.warehouse, s.year, s.month, item_name, manufacturer, total_sold,
          total_restocked, sale_days, avg_price, in_stock_days, last_stock, distinct_days,
          total_sold / case when sale_days = 0 then 1 else sale_days end as turnover,
          min_price, max_price, open_price, close_price,
          coalesce(close_price - open_price, 0.0) as price_change_abs,
          case when open_price = 0 and close_price > 0 then 'inf'::double
            when open_price = 0 then 0.0 else coalesce((close_price / open_price - 1) * 100, 0.0) end as price_change_pct
        from month_sums s join open_close p
          on s.item_code = p.item_code and s.warehouse = p.warehouse
          and s.year = p.year and s.month = p.month""",
    "totals": "{totals_of:monthly}",
    "sold_totals": "select * from totals where total_sold > 0",
    "fast": """
        select * from totals where total_sold > 0
        order by turnover desc nulls last, item_code, warehouse limit 1000""",
    "restocked_top": """
        select * from totals order by total_restocked desc nulls last, item_code, warehouse limit 1000""",
    "spikes": """
        select *, coalesce(total_sold > trailing_avg * 1.5, false) as is_spike from (
          select *, make_timestamp(year, month, 1, 0, 0, 0) as month_start,
            avg(total_sold) over (partition by item_code, warehouse order by year, month
              rows between 3 preceding and 1 preceding) as trailing_avg
          from monthly)""",
    "slow": """
        select * from totals where total_sold = 0 order by in_stock_days desc, item_code, warehouse limit 1000""",
    "keyed": "select *, coalesce(item_code, 'nan') || '|' || coalesce(item_name, 'nan') as item_key from snap",
    "name_counts": "select warehouse, item_code, item_name, count(*) as n from snap group by all",
    "names": """
        select warehouse, item_code,
          coalesce(first(item_name order by n desc, item_name) filter (where item_name is not null), '')
            as canonical_name
        from name_counts group by warehouse, item_code""",
    "canonical": """
        select s.*, canonical_name,
          coalesce(s.item_name <> canonical_name, true) as name_changed
        from snap s join names n on s.warehouse = n.warehouse and s.item_code = n.item_code""",
    "by_day": f"""
        select warehouse, item_key, date_trunc('day', dt) as dt, {_first('stock', 'dt, ' + ORDER)},
          {_first('price', 'dt, ' + ORDER)}, {_first('item_name', 'dt, ' + ORDER)},
          {_first('item_code', 'dt, ' + ORDER)}, cast(count(*) as bigint) as n_rows
        from keyed group by warehouse, item_key, date_trunc('day', keyed.dt)""",
    "day_moves": """
        select *, coalesce(stock - lag(stock) over w, 0.0) as diff,
          coalesce(price - lag(price) over w, 0.0) <> 0 as price_changed
        from by_day window w as (partition by warehouse, item_key order by dt)""",
    "metrics": """
        select * exclude (diff), greatest(-diff, 0.0) + 0.0 as sold, greatest(diff, 0.0) + 0.0 as restocked,
          (diff < 0 or diff > 0) and diff = 0 as is_anomaly
        from day_moves""",
    "enriched": """
        select warehouse, item_key, dt, stock, price, item_name,
          coalesce(item_name, '') as canonical_name, sold, restocked, price_changed, is_anomaly
        from metrics""",
    "sellers": """
        select item_key as item_code, canonical_name as item_name, warehouse, sum(sold) as sold
        from enriched group by all""",
    "item_days": "{series_of:enriched|warehouse, item_key|dt}",
    "named_days": "select * from enriched where canonical_name = 'small ring'",
    "name_series": "{series_of:named_days|warehouse|dt, item_key}",
    "plain_days": """
        select dt, warehouse, item_code as item_key, item_name as canonical_name, stock, price from daily""",
    "plain_series": "{series_of:plain_days|warehouse, item_key|dt}",
    "dated_text": """
        select event_id,
          case event_type when 'error' then 'n/a' when 'click' then strftime(ts, '%d.%m.%Y')
            when 'view' then strftime(ts, '%Y-%m-%d %H:%M:%S')
            else case event_id % 4 when 0 then strftime(ts, '%B %-d, %Y')
              when 1 then strftime(ts, '%-d %B %Y %H:%M') when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
              else strftime(ts, '%d/%m/%Y %H:%M') end
            end as date_text,
          case event_type when 'error' then props when 'click' then ' ' || cast(value as varchar) || chr(9)
            when 'view' then replace(cast(value as varchar), '.', ',') else cast(value as varchar)
            end as number_text,
          date_trunc('day', ts) as file_ts
        from events""",
    "codes": "select p_partkey, p_brand || '-' || p_type || '_' || p_name as code from part",
    "books": f"""
        select *, warehouse || '/' || strftime(dt, '%Y%m%d') || '_'
            || cast(l_orderkey // 100000 as varchar) || '.xlsx' as src_file
        from snap""",
    "book_lines": f"""
        select *, cast(4 + row_number() over (partition by src_file order by {ORDER}) as integer) as src_row
        from books""",
    "book_dates": """
        select src_file, warehouse, dt, count(*) as n, day(dt) = 1 as undated
        from books group by src_file, warehouse, dt""",
    "book_snaps": """
        select case when day(dt) = 1 then dt + interval 18 hours else dt end as dt, item_name,
          coalesce(stock, 0.0) as stock, coalesce(price, 0.0) as price, manufacturer, item_code,
          warehouse, src_file, src_row
        from book_lines""",
    "exports": """
        select * replace (round(avg_price + 1e-9, 6) as avg_price) from sold_totals
        where item_name is not null""",
    "widened": "select *, total_sold * 1000000 + 0.5 as large, max_price / 100000 as small from monthly",
    "rollup": f"""
        select dt, item_code, warehouse, coalesce(sum(stock), 0.0) as total_sold,
          first(price order by {ORDER}) filter (where price is not null) as day_open_price
        from snap group by dt, item_code, warehouse""",
    "conflicts": """
        with pairs as (
          select distinct item_name, item_code, upper(translate(item_code, '- ', '')) as item_code_norm,
            trim(replace(lower(item_name), 'дефект', '')) as item_name_norm
          from snap)
        select * from pairs where item_name_norm in (
          select item_name_norm from pairs group by item_name_norm
          having count(distinct item_code_norm) > 1)""",
}


def _totals_of(source: str) -> str:
    month = "year, month"
    return f"""
        select item_code, warehouse, {_first('item_name', month)}, {_first('manufacturer', month)},
          coalesce(sum(total_sold), 0.0) as total_sold,
          coalesce(sum(total_restocked), 0.0) as total_restocked,
          cast(case when sum(sale_days) = 0 then 1 else sum(sale_days) end as bigint) as sale_days,
          avg(avg_price) as avg_price, min(min_price) as min_price, max(max_price) as max_price,
          {_first('open_price', month)},
          last(close_price order by {month}) filter (where close_price is not null) as close_price,
          cast(sum(in_stock_days) as bigint) as in_stock_days,
          coalesce(sum(total_sold), 0.0) / case when sum(sale_days) = 0 then 1 else sum(sale_days) end
            as turnover
        from {source} group by item_code, warehouse"""


def _series_of(source: str, keys: str, order: str) -> str:
    window = f"partition by {keys} order by {order}"
    return f"""
        select dt, warehouse, item_key, canonical_name, stock, price, sold, restocked, trailing_avg,
          is_spike, price_changed,
          case when is_spike and price_changed then 'spike+price change' when is_spike then 'spike'
            when price_changed then 'price change' else 'ordinary' end as day_class,
          case when is_spike then 10 else 5 end as emphasis
        from (
          select *, coalesce(sold > 1.5 * trailing_avg, false) as is_spike from (
            select *, avg(sold) over ({window} rows between 6 preceding and current row) as trailing_avg
            from (
              select *, greatest(coalesce(lag(stock) over w - stock, 0.0), 0.0) + 0.0 as sold,
                greatest(coalesce(stock - lag(stock) over w, 0.0), 0.0) + 0.0 as restocked,
                coalesce(price - lag(price) over w, 0.0) <> 0 as price_changed
              from (select dt, warehouse, item_key, canonical_name, stock, price from {source})
              window w as ({window}))))"""


for _name, _text in list(PARTS.items()):
    if _text.startswith("{totals_of:"):
        PARTS[_name] = _totals_of(_text[11:-1])
    elif _text.startswith("{series_of:"):
        PARTS[_name] = _series_of(*_text[11:-1].split("|"))


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"(?:from|join)\s+([a-z_]+)", text))
    return [name for name in PARTS if name in words]


def _sql(text: str) -> str:
    """A query with the common table expressions it needs, in dependency order."""
    used: list[str] = []

    def visit(body: str) -> None:
        for name in _needs(body):
            if name not in used:
                visit(PARTS[name])
                used.append(name)

    visit(text)
    parts = ",\n".join(f"{name} as materialized ({PARTS[name]})" for name in used)
    return f"with {parts}\n{text}" if used else text


MONTH = "item_code, warehouse, year, month"
TOTAL_COLUMNS = (
    "item_code, warehouse, item_name, manufacturer, total_sold, total_restocked, sale_days, "
    "round(avg_price + 1e-9, 6) as avg_price, min_price, max_price, open_price, close_price, "
    "in_stock_days, turnover"
)
CLEAN_CODE = "upper(replace(item_code, '-', ''))"
CLEAN_TOTALS = TOTAL_COLUMNS.replace("item_code,", f"{CLEAN_CODE} as item_code,", 1)
FRACTION = (
    "case when open_price = 0 and close_price > 0 then 'inf'::double "
    "when open_price = 0 and close_price < 0 then '-inf'::double "
    "when open_price = 0 then null else " + _rint("(close_price - open_price) / open_price", 4) + " end"
)
EXPORT = (
    "item_code, warehouse, item_name, manufacturer, total_sold, total_restocked, "
    f"sale_days as times_sold, {_rint('avg_price', 2)} as avg_price, {_rint('min_price', 2)} as min_price, "
    f"{_rint('max_price', 2)} as max_price, open_price, close_price, in_stock_days as times_in_stock, "
    f"turnover, {FRACTION} as price_change_frac"
)
NUMBER = (
    "case when regexp_full_match(trim(number_text, ' ' || chr(9)), "
    r"'[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') then try_cast(trim(number_text, ' ' || chr(9)) as double) end"
)
AS_OF = (
    "coalesce(try_strptime(date_text, '%d.%m.%Y'), try_strptime(date_text, '%d/%m/%Y %H:%M'), "
    "try_strptime(date_text, '%Y-%m-%d %H:%M:%S'), try_strptime(date_text, '%B %d, %Y'), "
    "try_strptime(date_text, '%d %B %Y %H:%M'), "
    "try_strptime(replace(replace(date_text, 'T', ' '), 'Z', ''), '%Y-%m-%d %H:%M:%S'))"
)


def _rank(source: str, measure: str) -> str:
    return f"""
        select warehouse, item_name, item_code, sum({measure}) as {measure} from {source}
        where item_name is not null group by all
        order by {measure} desc, warehouse, item_name, item_code limit 100"""


def _export(source: str, measure: str) -> str:
    return f"""
        select {EXPORT} from (
          select * from {source} where item_name is not null
          order by {measure} desc, item_code, warehouse limit 100)"""


_WIDE = [
    "item_code", "warehouse", "year", "month", "item_name", "manufacturer", "total_sold",
    "total_restocked", "last_stock", "min_price", "max_price", "open_price", "sale_days", "large", "small",
]
_WIDTHS = " union all ".join(
    f"""select '{c}' as "column", cast(2 + greatest({len(c)},
      max(length(coalesce(cast({c} as varchar), 'nan')))) as integer) as width from widened"""
    for c in _WIDE
)

_TABLE_COUNTS = " union all ".join(
    f"select '{name}' as table_name, cast(count(*) as bigint) as n_rows from {source}"
    for name, source in {
        "monthly": "monthly",
        "transfers": "transfers",
        "identity_conflicts": "conflicts",
        "item_totals": "totals",
        "top_fast": "fast",
        "top_slow": "slow",
        "top_restocked": "restocked_top",
        "daily_rollup": "rollup",
    }.items()
)

_QUERIES = {
    "norm_code": "select p_partkey, code, upper(translate(code, '- _', '')) as code_norm from codes",
    "norm_code_weak": "select p_partkey, code, upper(translate(code, '- ', '')) as code_norm from codes",
    "norm_name": f"""
        select {LINE}, item_name, trim(replace(lower(item_name), 'дефект', '')) as item_name_norm from snap""",
    "strip_ws": f"""
        select doc_id, trim(chr(160) || chr(9) || text || ' ' || chr(12288) || chr(10), {WS}) as stripped
        from documents""",
    "parse_dt": """
        select event_id, date_text, coalesce(try_strptime(date_text, '%Y-%m-%d %H:%M:%S'),
          try_strptime(date_text, '%d.%m.%Y'), try_strptime(date_text, '%d/%m/%Y %H:%M')) as parsed
        from dated_text""",
    "day_trunc": "select event_id, date_trunc('day', ts) as day from events",
    "year_month": """
        select o_orderkey, o_orderdate as dt, cast(year(o_orderdate) as integer) as year,
          cast(month(o_orderdate) as integer) as month from orders""",
    "month_start": "select o_orderkey, date_trunc('month', o_orderdate) as month_start from orders",
    "to_number": f"""
        select event_id, number_text, {NUMBER} as number, coalesce({NUMBER}, 0.0) as number_or_zero
        from dated_text""",
    "to_flag": """
        select event_id, case event_type when 'error' then null when 'click' then 'false' else 'true' end
          as flag_text, event_type <> 'click' as flag from events""",
    "conform": f"""
        select {MONTH}, total_sold, cast(null as double) as avg_price, cast(0 as bigint) as sale_days
        from monthly""",
    "rename": f"select {LINE}, dt, item_code, warehouse, stock, price from snap",
    "round_prices": f"""
        select {MONTH}, {_rint('avg_price', 2)} as avg_price, {_rint('min_price', 2)} as min_price,
          {_rint('max_price', 2)} as max_price from monthly""",
    "sold_restocked": """
        select item_code, warehouse, dt, stock_diff,
          case when stock_diff < 0 then -stock_diff else 0.0 end as sold,
          case when stock_diff > 0 then stock_diff else 0.0 end as restocked from moved""",
    "item_turnover": f"select {MONTH}, total_sold, sale_days, turnover from monthly",
    "turnover_by_avg_stock": f"""
        select t.item_code, t.warehouse, total_sold, {_rint('total_sold / avg_stock', 2)} as turnover
        from totals t join (select item_code, warehouse, avg(stock) as avg_stock from daily group by all) a
          on t.item_code = a.item_code and t.warehouse = a.warehouse""",
    "spike_turnover": f"select {MONTH}, total_sold, total_sold / 10 as turnover from monthly",
    "price_change": f"""
        select {MONTH}, open_price, close_price, coalesce(close_price - open_price, 0.0) as price_change_abs,
          case when open_price = 0 and close_price > 0 then 'inf'::double when open_price = 0 then 0.0
            else coalesce((close_price / open_price - 1) * 100, 0.0) end as price_change_pct from open_close""",
    "price_change_fraction": f"""
        select {MONTH}, open_price, close_price, {FRACTION} as price_change_frac from open_close""",
    "least_days": f"""
        select {MONTH}, in_stock, days, least(in_stock, days) as in_stock_days from (
          select item_code, warehouse, cast(year(dt) as integer) as year, cast(month(dt) as integer) as month,
            cast(count(*) filter (where stock > 0) as bigint) as in_stock,
            cast(count(distinct dt) as bigint) as days
          from snap group by all)""",
    "classify_day": """
        select warehouse, item_key, dt, is_spike, price_changed, day_class, emphasis from item_days""",
    "item_key": f"select {LINE}, item_key from keyed",
    "name_changed": f"select {LINE}, item_name, canonical_name, name_changed from canonical",
    "fill_nulls": f"select {LINE}, coalesce(stock, 0.0) as stock, coalesce(price, 0.0) as price from snap",
    "fmt_date": "select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as date_text from orders",
    "format_report": f"""
        select item_code, warehouse,
          format('{{:,.2f}} ₽', avg_price) as avg_price, format('{{:,.2f}} ₽', open_price) as open_price,
          format('{{:,.2f}} ₽', close_price) as close_price,
          format('{{:,.0f}}', total_restocked) as total_restocked,
          format('{{:,.0f}}', turnover) as turnover,
          case when isinf(price_change_frac) then 'Infinity%'
            else format('{{:.2f}}%', price_change_frac * 100) end as price_change_frac
        from (select {EXPORT} from exports)""",
    "require_keys": f"select {LINE}, stock, price from snap where stock is not null and price is not null",
    "inflows": """
        select dt, item_code, warehouse as to_warehouse, stock_diff as qty from flows where stock_diff > 0""",
    "outflows": """
        select dt, item_code, warehouse as from_warehouse, -stock_diff as qty from flows where stock_diff < 0""",
    "in_warehouses": f"select {LINE}, warehouse, stock from snap where warehouse in ('WH-A', 'WH-N')",
    "select_items": f"""
        select {LINE}, warehouse, item_code, item_name, stock from snap
        where warehouse = 'WH-A' and item_code = 'it-000007'""",
    "select_items_guard": f"""
        select {LINE}, warehouse, item_code, item_name from snap where item_name = 'small ring'""",
    "without_anomalies": f"select {LINE}, stock, l_tax = 0.08 as is_anomaly from snap where l_tax <> 0.08",
    "daily_snapshot": "select * from daily",
    "daily_rollup": "select * from rollup",
    "with_flows": "select * from flows",
    "detect_transfers": "select * from transfers",
    "net_of_transfers": "select item_code, warehouse, dt, stock_diff, sold, restocked from net",
    "price_days": f"""
        select {MONTH}, price, cast(count(distinct dt) as bigint) as days_at_price from dated
        where price is not null group by {MONTH}, price""",
    "price_days_join": """
        select a.item_code, a.warehouse, a.dt, a.price, b.months
        from dated a join (
          select item_code, warehouse, price,
            string_agg(distinct strftime(dt, '%Y-%m'), ',' order by strftime(dt, '%Y-%m')) as months
          from dated group by item_code, warehouse, price) b
          on a.item_code = b.item_code and a.warehouse = b.warehouse and a.price = b.price""",
    "monthly_price_range": f"""
        select {MONTH}, min(price) as min_price, max(price) as max_price from dated group by {MONTH}""",
    "monthly_open_close": "select * from open_close",
    "monthly_summary": "select * from monthly",
    "item_totals": f"select {TOTAL_COLUMNS} from totals",
    "top_fast": f"select {TOTAL_COLUMNS} from fast",
    "top_slow": f"select {TOTAL_COLUMNS} from slow",
    "top_restocked": f"select {TOTAL_COLUMNS} from restocked_top",
    "rank_base": """
        select warehouse, item_name, item_code, sum(total_sold) as total_sold from monthly
        where item_name is not null group by all""",
    "rank_fast": _rank("sold_totals", "total_sold"),
    "rank_restock": _rank("totals", "total_restocked"),
    "export_top_fast": _export("sold_totals", "total_sold"),
    "export_top_restock": _export("totals", "total_restocked"),
    "identity_conflicts": "select * from conflicts",
    "canonical_names": f"""
        select {LINE}, warehouse, item_code, item_name, canonical_name, name_changed
        from canonical""",
    "name_variants": "select distinct warehouse, item_code, item_name from snap where item_name is not null",
    "variants_text": """
        select warehouse, item_code, string_agg(distinct item_name, ', ' order by item_name) as name_variants
        from snap where item_name is not null group by warehouse, item_code""",
    "find_spikes": "select * from spikes",
    "tail_by_date": """
        select item_code, warehouse, month_start, total_sold, is_spike from spikes
        order by month_start desc, item_code desc, warehouse desc limit 200""",
    "spike_series": """
        select month_start, warehouse, item_code, item_name, 'total_sold' as metric, total_sold as value
        from spikes union all
        select month_start, warehouse, item_code, item_name, 'avg_price', avg_price from spikes union all
        select month_start, warehouse, item_code, item_name, 'price_change_pct', price_change_pct
        from spikes""",
    "name_options": """
        select distinct item_name from monthly where warehouse = 'WH-A' and item_name is not null""",
    "export_spikes": f"""
        select {MONTH}, total_sold, trailing_avg, is_spike, turnover from spikes""",
    "enrich_daily": "select * from enriched",
    "enrich_daily_by_code": """
        select m.warehouse, item_key, dt, stock, price, item_name, canonical_name, sold, restocked,
          price_changed, is_anomaly
        from metrics m join names n on m.warehouse = n.warehouse and m.item_code = n.item_code""",
    "daily_by_day": "select warehouse, item_key, dt, stock, price, item_name, n_rows from by_day",
    "daily_metrics": """
        select warehouse, item_key, dt, stock, price, item_name, sold, restocked, price_changed, is_anomaly
        from metrics""",
    "price_changed": "select warehouse, item_key, dt, price, price_changed from day_moves",
    "item_line": """
        select dt, warehouse, item_key, canonical_name, stock, sold, restocked, price, price_changed,
          is_anomaly from enriched""",
    "item_series": "select * from item_days",
    "item_series_by_name": "select * from name_series",
    "day_spikes": "select warehouse, item_key, dt, sold, trailing_avg, is_spike from plain_series",
    "top_sellers": """
        select * from sellers order by sold desc, item_code, item_name, warehouse limit 100""",
    "drill_down": """
        select warehouse, item_key, canonical_name, dt, stock, sold from enriched
        where (item_key, canonical_name) in (
          select (item_code, item_name) from (
            select * from sellers order by sold desc, item_code, item_name, warehouse limit 100))""",
    "stored_item_line": """
        select dt, warehouse, item_key, canonical_name, stock, sold, restocked, price, price_changed,
          is_anomaly from enriched
        where item_key = 'it-000007|small ring'""",
    "stored_drill_down": """
        select warehouse, item_key, canonical_name, dt, stock, sold from enriched
        where (item_key, canonical_name) in (
          select (item_code, item_name) from (
            select * from sellers order by sold desc, item_code, item_name, warehouse limit 100))""",
    "options_warehouse": "select distinct warehouse from enriched",
    "options_item": "select distinct item_key from enriched",
    "options_name": "select distinct canonical_name from enriched",
    "column_widths": _WIDTHS,
    "union_all": f"""
        select {LINE}, dt, item_code, warehouse, stock, price, null::varchar as item_name from snap
        union all by name select p_brand as item_code, p_name as item_name from part""",
    "snapshots_from_grid": "select * from book_snaps",
    "load_snapshots": "select * from book_snaps",
    "resolve_as_of": f"""
        select event_id, date_text, coalesce({AS_OF}, file_ts) as as_of,
          case when {AS_OF} is null then 'file' else 'cell' end as date_source from dated_text""",
    "ingest_audit": """
        select warehouse, src_file, cast(n as bigint) as item_lines,
          case when undated then 'file' else 'cell' end as date_source, cast(null as varchar) as error
        from book_dates""",
    "read_enriched_daily": "select * replace (trim(item_name) as item_name) from enriched",
    "load_monthly": f"""
        select {MONTH}, make_timestamp(year, month, 1, 0, 0, 0) as month_start, item_name, total_sold,
          avg_price, price_change_pct from monthly""",
    "roundtrip_parquet": "select * from monthly",
    "roundtrip_csv": "select * from rollup",
    "month_analysis": _TABLE_COUNTS,
    "month_update": f"select * replace ({CLEAN_CODE} as item_code) from monthly",
    "month_analysis_totals": f"select {CLEAN_TOTALS} from totals",
    "month_analysis_monthly": f"select * replace ({CLEAN_CODE} as item_code) from monthly",
    "month_analysis_transfers": f"select * replace ({CLEAN_CODE} as item_code) from transfers",
    "month_analysis_conflicts": f"select * replace ({CLEAN_CODE} as item_code) from conflicts",
    "month_analysis_top_fast": f"select {CLEAN_TOTALS} from fast",
    "month_analysis_top_slow": f"select {CLEAN_TOTALS} from slow",
    "month_analysis_top_restocked": f"select {CLEAN_TOTALS} from restocked_top",
    "month_analysis_rollup": f"select * replace ({CLEAN_CODE} as item_code) from rollup",
    "export_saved": _export("sold_totals", "total_sold"),
    "read_spikes": "select * from spikes",
}

ORACLES = {name: _sql(text) for name, text in _QUERIES.items()}
