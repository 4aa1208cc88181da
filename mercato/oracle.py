"""Independent SQL re-statement of the models, for DuckDB.

Used only to check the Spark plans: every registered query has an SQL twin
here that starts from the same driver tables (views `orders`, `lineitem`, …)
and re-derives bronze → silver → gold in plain SQL.  Engine differences
handled explicitly:
  * DuckDB `concat` skips NULLs, Spark's propagates them → use `||` here.
  * DuckDB `dayofweek` is 0-based → weekend = isodow IN (6, 7).
  * money sums are exact decimals cast to DOUBLE at the end (as in Spark).
"""

from __future__ import annotations

import math

TOKEN = "'_dbt_utils_surrogate_key_null_'"


def sk(*cols: str) -> str:
    parts = [f"coalesce(CAST({c} AS VARCHAR), {TOKEN})" for c in cols]
    return "md5(" + " || '-' || ".join(parts) + ")"


def rev(prefix: str = "") -> str:
    p = prefix
    return (f"({p}quantity * CAST({p}unit_price AS DECIMAL(10,2)) "
            f"* (1 - TRY_CAST({p}discount AS DECIMAL(14,12))))")


NULLS = lambda *cs: ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in cs)

BRONZE = f"""
b_orders AS (
  SELECT o.o_orderkey AS order_id, CAST(o.o_custkey AS VARCHAR) AS customer_id, po.employee_id,
         CAST(o.o_orderdate AS DATE) AS order_date, CAST(NULL AS DATE) AS required_date, po.shipped_date,
         CAST(NULL AS INTEGER) AS ship_via, CAST(0.0 AS DOUBLE) AS freight,
         {NULLS(('ship_name','VARCHAR'),('ship_address','VARCHAR'),('ship_city','VARCHAR'),('ship_region','VARCHAR'),('ship_postal_code','VARCHAR'),('ship_country','VARCHAR'))}
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS employee_id, CAST(max(l_shipdate) AS DATE) AS shipped_date
             FROM lineitem GROUP BY l_orderkey) po ON o.o_orderkey = po.l_orderkey
),
b_order_details AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id,
         floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS unit_price,
         CAST(l_quantity AS INTEGER) AS quantity, l_discount AS discount
  FROM lineitem
),
b_categories AS (
  SELECT CAST(dense_rank() OVER (ORDER BY category_name) AS BIGINT) AS category_id, category_name,
         'Parts of type ' || category_name AS description
  FROM (SELECT DISTINCT p_type AS category_name FROM part) t
),
b_products AS (
  SELECT p.p_partkey AS product_id, p.p_name AS product_name, s.supplier_id, c.category_id,
         CAST(NULL AS VARCHAR) AS quantity_per_unit, p.p_retailprice AS unit_price,
         CAST(NULL AS INTEGER) AS units_in_stock, CAST(NULL AS INTEGER) AS units_on_order,
         CAST(NULL AS INTEGER) AS reorder_level, 0 AS discontinued
  FROM part p
  LEFT JOIN b_categories c ON p.p_type = c.category_name
  LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS supplier_id FROM lineitem GROUP BY l_partkey) s
         ON p.p_partkey = s.l_partkey
),
sup_ AS (
  SELECT s_suppkey, min(s_name) AS s_name, min(n_name) AS n_name
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY s_suppkey
),
b_suppliers AS (
  SELECT s_suppkey AS supplier_id, s_name AS company_name,
         {NULLS(('contact_name','VARCHAR'),('contact_title','VARCHAR'),('address','VARCHAR'),('city','VARCHAR'),('region','VARCHAR'),('postal_code','VARCHAR'))},
         n_name AS country, {NULLS(('phone','VARCHAR'),('fax','VARCHAR'),('homepage','VARCHAR'))}
  FROM sup_
),
b_employees AS (
  SELECT s_suppkey AS employee_id, s_name AS last_name, 'Agent' AS first_name, 'Sales Representative' AS title,
         {NULLS(('title_of_courtesy','VARCHAR'),('birth_date','DATE'),('hire_date','DATE'),('address','VARCHAR'),('city','VARCHAR'),('region','VARCHAR'),('postal_code','VARCHAR'))},
         n_name AS country, CAST(NULL AS BIGINT) AS reports_to
  FROM sup_
),
b_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS company_name,
         {NULLS(('contact_name','VARCHAR'),('contact_title','VARCHAR'),('address','VARCHAR'),('city','VARCHAR'))},
         r_name AS region, CAST(NULL AS VARCHAR) AS postal_code, n_name AS country,
         {NULLS(('phone','VARCHAR'),('fax','VARCHAR'))}
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
)"""

SILVER = """
stg_orders AS (
  SELECT TRY_CAST(order_id AS BIGINT) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
         TRY_CAST(employee_id AS BIGINT) AS employee_id, TRY_CAST(order_date AS DATE) AS order_date,
         TRY_CAST(required_date AS DATE) AS required_date, TRY_CAST(shipped_date AS DATE) AS shipped_date,
         TRY_CAST(ship_via AS INTEGER) AS ship_via, TRY_CAST(freight AS DOUBLE) AS freight,
         trim(ship_name) AS ship_name, trim(ship_address) AS ship_address, trim(ship_city) AS ship_city,
         coalesce(trim(ship_region), 'N/A') AS ship_region, trim(ship_postal_code) AS ship_postal_code,
         trim(ship_country) AS ship_country
  FROM b_orders
),
stg_order_details AS (
  SELECT TRY_CAST(order_id AS BIGINT) AS order_id, TRY_CAST(product_id AS BIGINT) AS product_id,
         TRY_CAST(unit_price AS DECIMAL(10,2)) AS unit_price, TRY_CAST(quantity AS INTEGER) AS quantity,
         TRY_CAST(discount AS DOUBLE) AS discount,
         TRY_CAST(unit_price AS DECIMAL(10,2)) * TRY_CAST(quantity AS INTEGER) * (1 - TRY_CAST(discount AS DOUBLE)) AS line_revenue,
         CAST(TRY_CAST(order_id AS BIGINT) AS VARCHAR) || '-' || CAST(TRY_CAST(product_id AS BIGINT) AS VARCHAR) AS order_detail_id
  FROM b_order_details
),
stg_customers AS (
  SELECT CAST(customer_id AS VARCHAR) AS customer_id, trim(company_name) AS company_name,
         trim(contact_name) AS contact_name, trim(contact_title) AS contact_title, trim(address) AS address,
         trim(city) AS city, coalesce(trim(region), 'N/A') AS region, trim(postal_code) AS postal_code,
         trim(country) AS country, trim(phone) AS phone
  FROM b_customers
),
stg_products AS (
  SELECT TRY_CAST(product_id AS BIGINT) AS product_id, trim(product_name) AS product_name,
         TRY_CAST(supplier_id AS BIGINT) AS supplier_id, TRY_CAST(category_id AS BIGINT) AS category_id,
         TRY_CAST(unit_price AS DECIMAL(10,2)) AS unit_price, TRY_CAST(units_in_stock AS INTEGER) AS units_in_stock,
         TRY_CAST(units_on_order AS INTEGER) AS units_on_order, TRY_CAST(reorder_level AS INTEGER) AS reorder_level,
         TRY_CAST(discontinued AS INTEGER) AS is_discontinued
  FROM b_products
),
stg_categories AS (
  SELECT TRY_CAST(category_id AS BIGINT) AS category_id, trim(category_name) AS category_name,
         trim(description) AS description
  FROM b_categories
),
stg_employees AS (
  SELECT TRY_CAST(employee_id AS BIGINT) AS employee_id, trim(first_name) AS first_name, trim(last_name) AS last_name,
         trim(first_name) || ' ' || trim(last_name) AS full_name, trim(title) AS title,
         TRY_CAST(birth_date AS DATE) AS birth_date, TRY_CAST(hire_date AS DATE) AS hire_date, trim(city) AS city,
         coalesce(trim(region), 'N/A') AS region, trim(country) AS country, TRY_CAST(reports_to AS BIGINT) AS reports_to
  FROM b_employees
),
stg_suppliers AS (
  SELECT TRY_CAST(supplier_id AS BIGINT) AS supplier_id, trim(company_name) AS company_name,
         trim(contact_name) AS contact_name, trim(contact_title) AS contact_title, trim(city) AS city,
         trim(region) AS region, trim(postal_code) AS postal_code, trim(country) AS country, trim(phone) AS phone
  FROM b_suppliers
)"""

GOLD = f"""
dim_customers AS (
  SELECT {sk('customer_id')} AS customer_key, customer_id, company_name, city, country, region FROM stg_customers
),
dim_products AS (
  SELECT {sk('p.product_id')} AS product_key, p.product_id, p.product_name, c.category_name,
         s.company_name AS supplier_name, p.unit_price, CAST(p.is_discontinued AS BOOLEAN) AS is_discontinued
  FROM stg_products p
  LEFT JOIN stg_categories c ON p.category_id = c.category_id
  LEFT JOIN stg_suppliers s ON p.supplier_id = s.supplier_id
),
dim_employees AS (
  SELECT {sk('employee_id')} AS employee_key, employee_id, first_name || ' ' || last_name AS full_name,
         title, country, reports_to
  FROM stg_employees
),
date_bounds_ AS (
  SELECT CAST(date_trunc('year', min(order_date)) AS DATE) AS s,
         CAST(date_trunc('year', max(order_date)) + INTERVAL 1 YEAR AS DATE) AS e
  FROM stg_orders
),
dim_date AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date, CAST(day(d) AS INTEGER) AS day,
         CAST(month(d) AS INTEGER) AS month, CAST(quarter(d) AS INTEGER) AS quarter,
         CAST(year(d) AS INTEGER) AS year, isodow(d) IN (6, 7) AS is_weekend
  FROM (SELECT CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP) - INTERVAL 1 DAY,
                                           INTERVAL 1 DAY)) AS DATE) AS d
        FROM date_bounds_) t
),
fact_sales AS (
  SELECT o.order_id, {sk('o.order_id', 'od.product_id')} AS order_detail_id,
         {sk('o.customer_id')} AS customer_key, {sk('od.product_id')} AS product_key,
         {sk('o.employee_id')} AS employee_key, CAST(strftime(o.order_date, '%Y%m%d') AS INTEGER) AS date_key,
         od.quantity, od.unit_price, od.discount,
         CAST(od.quantity * od.unit_price * (1 - od.discount) AS DOUBLE) AS line_revenue, o.freight
  FROM stg_orders o JOIN stg_order_details od ON o.order_id = od.order_id
),
daily_sales_ AS (
  SELECT dd.full_date AS sale_date, dp.category_name AS product_category,
         sum({rev('fs.')}) AS rev_, count(DISTINCT fs.order_id) AS total_orders,
         CAST(sum(fs.quantity) AS BIGINT) AS total_quantity
  FROM fact_sales fs JOIN dim_date dd ON fs.date_key = dd.date_key
  JOIN dim_products dp ON fs.product_key = dp.product_key
  GROUP BY 1, 2
),
daily_category_sales AS (
  SELECT sale_date, product_category, CAST(rev_ AS DOUBLE) AS total_revenue, total_orders, total_quantity,
         CASE WHEN total_orders = 0 THEN 0.0 ELSE CAST(rev_ AS DOUBLE) / total_orders END AS avg_order_value, rev_
  FROM daily_sales_
),
filled_ AS (
  SELECT sp.sale_date, sp.year, sp.product_category,
         coalesce(ds.total_revenue, 0.0) AS total_revenue, CAST(coalesce(ds.total_orders, 0) AS BIGINT) AS total_orders,
         CAST(coalesce(ds.total_quantity, 0) AS BIGINT) AS total_quantity,
         coalesce(ds.avg_order_value, 0.0) AS avg_order_value, coalesce(ds.rev_, 0) AS rev_
  FROM (SELECT d.full_date AS sale_date, d.year, c.product_category
        FROM dim_date d CROSS JOIN (SELECT DISTINCT category_name AS product_category FROM dim_products
                                    WHERE category_name IS NOT NULL) c) sp
  LEFT JOIN daily_category_sales ds ON sp.sale_date = ds.sale_date AND sp.product_category = ds.product_category
),
wide_sales_forecast_ AS (
  SELECT sale_date, year, product_category, total_revenue, total_orders, total_quantity, avg_order_value,
         CAST(sum(rev_) OVER (PARTITION BY product_category ORDER BY sale_date
                              ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) AS revenue_7d_rolling,
         CAST(sum(rev_) OVER (PARTITION BY product_category ORDER BY sale_date
                              ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS DOUBLE) AS revenue_30d_rolling,
         rev_
  FROM filled_
),
wide_sales_forecast AS (
  SELECT sale_date, year, product_category, total_revenue, total_orders, total_quantity, avg_order_value,
         revenue_7d_rolling, revenue_30d_rolling
  FROM wide_sales_forecast_
)"""

PRELUDE = "WITH " + BRONZE.strip() + ",\n" + SILVER.strip() + ",\n" + GOLD.strip()


def sql(select: str, extra_ctes: str = "") -> str:
    """Full statement: the model CTEs, optional extra CTEs, then `select`."""
    head = PRELUDE + (",\n" + extra_ctes.strip() if extra_ctes.strip() else "")
    return head + "\n" + select.strip()


def sql_of_orders(condition: str, select: str) -> str:
    """`select` over the models of a lake that holds only the orders (of `stg_orders_all_`)
    that meet the condition, and their lines."""
    head = (PRELUDE.replace("stg_orders AS (", "stg_orders_all_ AS (", 1).replace("stg_order_details AS (", "stg_order_details_all_ AS (", 1)
            .replace("stg_customers AS (", f"stg_orders AS (SELECT * FROM stg_orders_all_ WHERE {condition}),\n"
                     "stg_order_details AS (SELECT * FROM stg_order_details_all_ WHERE order_id IN (SELECT order_id FROM stg_orders)),\n"
                     "stg_customers AS (", 1))
    return head + "\n" + select.strip()


# analytics building blocks shared by several statements
ANALYTICS = """
series_ AS (
  SELECT sale_date, CAST(sum(rev_) AS DOUBLE) AS total_revenue, sum(rev_) AS rev_
  FROM wide_sales_forecast_ GROUP BY sale_date
),
bounds_ AS (SELECT min(sale_date) AS mn, max(sale_date) AS mx FROM wide_sales_forecast_ WHERE total_revenue > 0),
range_ AS (
  SELECT coalesce(mn, DATE '1996-07-04') AS start_date, coalesce(mx, DATE '1998-05-06') AS end_date FROM bounds_
),
active_ AS (SELECT s.* FROM series_ s, bounds_ b WHERE s.sale_date BETWEEN b.mn AND b.mx),
positive_ AS (SELECT * FROM series_ WHERE total_revenue > 0),
fact_range_ AS (
  SELECT fs.*, dd.full_date FROM fact_sales fs JOIN dim_date dd ON fs.date_key = dd.date_key, range_ r
  WHERE dd.full_date BETWEEN r.start_date AND r.end_date
)"""

PRELUDE = PRELUDE + ",\n" + ANALYTICS.strip()


def spark_percentiles(src: str, y: str, ps: dict[str, float], group: str | None = None) -> str:
    """SELECT statement computing Spark's `percentile` (position (n−1)·p, linear
    interpolation written as (hi−pos)·x_lo + (pos−lo)·x_hi) per `group`."""
    part = f"PARTITION BY {group}" if group else ""
    gsel = f"{group}, " if group else ""
    gby = f"GROUP BY {group}" if group else ""
    picks, outs = [], []
    for name, p in ps.items():
        pos = f"({p} * (n - 1))"
        picks.append(f"max(CASE WHEN i = floor({pos}) THEN {y} END) AS lo_{name}, "
                     f"max(CASE WHEN i = ceil({pos}) THEN {y} END) AS hi_{name}")
        outs.append(f"CASE WHEN floor({p} * (n - 1)) = ceil({p} * (n - 1)) OR lo_{name} = hi_{name} THEN lo_{name} "
                    f"ELSE (ceil({p} * (n - 1)) - {p} * (n - 1)) * lo_{name} "
                    f"+ ({p} * (n - 1) - floor({p} * (n - 1))) * hi_{name} END AS {name}")
    return (f"SELECT {gsel}n, {', '.join(outs)} FROM ("
            f"SELECT {gsel}any_value(n) AS n, {', '.join(picks)} FROM ("
            f"SELECT *, row_number() OVER ({part} ORDER BY {y}) - 1 AS i, count(*) OVER ({part}) AS n "
            f"FROM {src}) r {gby}) t")


def suite_sql(suite) -> str:
    """The data-quality suite as one UNION ALL statement (model, test, column, failures)."""
    parts = []

    def row(model, test, col, expr):
        return (f"SELECT '{model}' AS model, '{test}' AS test, '{col}' AS \"column\", "
                f"CAST(({expr}) AS BIGINT) AS failures")

    for t in suite:
        m = t.model
        for c in t.not_null:
            parts.append(row(m, "not_null", c, f"SELECT count(*) FROM {m} WHERE {c} IS NULL"))
        for c in t.unique:
            parts.append(row(m, "unique", c, f"SELECT count(*) FROM (SELECT {c} FROM {m} WHERE {c} IS NOT NULL "
                                             f"GROUP BY {c} HAVING count(*) > 1) x"))
        for c, parent, fld in t.relationships:
            parts.append(row(m, "relationships", c,
                             f"SELECT count(*) FROM {m} ch WHERE ch.{c} IS NOT NULL AND NOT EXISTS "
                             f"(SELECT 1 FROM {parent} p WHERE p.{fld} = ch.{c})"))
        for cols in t.unique_combination:
            cs = ", ".join(cols)
            parts.append(row(m, "unique_combination", ",".join(cols),
                             f"SELECT count(*) FROM (SELECT {cs} FROM {m} GROUP BY {cs} HAVING count(*) > 1) x"))
        for label, _ in t.expressions:
            parts.append(row(m, "expression", label,
                             f"SELECT count(*) FROM {m} WHERE NOT coalesce((SELECT max(sale_date) FROM {m}) "
                             f">= DATE '1998-01-01', false)"))
    return "\nUNION ALL\n".join(parts)




def q(s: str) -> str:
    """SQL string literal"""
    return "'" + s.replace("'", "''") + "'"


BLANKS = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, {q('^' + BLANKS + '+|' + BLANKS + '+$')}, '', 'g')"


NOT_WORD = r"([^\pL\pN_]|$)"


def screening_sql(src: str, text: str, keep: list[str], keywords, fence: str, block: str, line: str) -> str:
    """R-01 in DuckDB: the same regexes (RE2), replace-all via the 'g' flag."""
    no_fence = _strip(f"regexp_replace({text}, {q(fence)}, '', 'g')")
    cleaned = _strip(f"regexp_replace({no_fence}, {q(';+$')}, '', 'g')")
    nocom = f"regexp_replace(regexp_replace(cleaned_, {q(block)}, ' ', 'g'), {q(line)}, ' ', 'g')"
    # RE2 has no look-around: a boundary is "start/end or a non-word character"
    first = "coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches(nocom_, {q(r'(?i)(^|[^\pL\pN_])' + k + NOT_WORD)}) THEN {q(k)} END"
        for k in keywords) + ")"
    lead = f"(?i)^{BLANKS}*(SELECT|WITH)" + NOT_WORD
    verdict = (f"CASE WHEN {text} IS NULL OR {_strip(text)} = '' THEN 'empty' "
               f"WHEN strpos(nocom_, ';') > 0 THEN 'multiple' "
               f"WHEN NOT regexp_matches({_strip('nocom_')}, {q(lead)}) THEN 'not_select' "
               f"WHEN first_forbidden IS NOT NULL THEN 'forbidden' ELSE 'ok' END")
    cols = ", ".join(keep)
    return (f"SELECT {cols}, verdict, CASE WHEN verdict = 'forbidden' THEN first_forbidden END AS keyword, "
            f"CASE WHEN verdict = 'ok' THEN cleaned_ END AS cleaned, first_forbidden FROM ("
            f"SELECT *, {verdict} AS verdict FROM ("
            f"SELECT *, {first} AS first_forbidden FROM ("
            f"SELECT *, {nocom} AS nocom_ FROM ("
            f"SELECT *, {cleaned} AS cleaned_ FROM {src}) a) b) c) d")


def fact_select(orders: str, details: str) -> str:
    """The fact's SELECT over any two order / order-line relations."""
    return (f"SELECT o.order_id, {sk('o.order_id', 'od.product_id')} AS order_detail_id, "
            f"{sk('o.customer_id')} AS customer_key, {sk('od.product_id')} AS product_key, "
            f"{sk('o.employee_id')} AS employee_key, CAST(strftime(o.order_date, '%Y%m%d') AS INTEGER) AS date_key, "
            "od.quantity, od.unit_price, od.discount, "
            "CAST(od.quantity * od.unit_price * (1 - od.discount) AS DOUBLE) AS line_revenue, o.freight "
            f"FROM {orders} o JOIN {details} od ON o.order_id = od.order_id")


def draw(seed: int, what: str, *parts: str) -> str:
    """A number in [0, 1) from the first 52 bits of the md5 of seed, field and id."""
    text = f"'{seed}:{what}'" + "".join(f" || ':' || CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0)"


def draw_int(u: str, lo: int, hi: int) -> str:
    return f"(CAST(floor({u} * {hi - lo + 1}) AS INTEGER) + {lo})"


def _numbered(src: str, key: str) -> str:
    """Rows of `src` numbered from 0 by the md5 of the key, three digits of it, then the key."""
    return f"SELECT *, row_number() OVER (ORDER BY substr(md5(CAST({key} AS VARCHAR)), 1, 3), {key}) - 1 AS idx FROM {src}"


def _between(u: str, lo: float, hi: float) -> str:
    return f"({lo!r}e0 + {u} * {hi - lo!r}e0)"


def synthetic_orders_ctes(x) -> str:
    """The generator of new orders, of the constants in module `x`."""
    seed, o = x.DEFAULTS["seed"], "order_id"
    mean = x.DEFAULTS["per_day"]
    gauss = (f"sqrt(-2e0 * ln(greatest({draw(seed, 'n1', 'day_no')}, 1e-300))) "
             f"* cos({2 * math.pi!r}e0 * {draw(seed, 'n2', 'day_no')})")
    return f"""
days_ AS (
  SELECT CAST(i AS INTEGER) AS day_no FROM range({x.DEFAULTS['days']}) t(i)
),
sized_ AS (SELECT day_no, greatest(1, CAST(trunc({mean} + {gauss} * {mean * 0.25!r}e0) AS INTEGER)) AS n FROM days_),
placed_ AS (SELECT day_no, n, coalesce(sum(n) OVER (ORDER BY day_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM sized_),
last_ AS (SELECT max(order_id) AS id, max(order_date) AS day FROM b_orders),
made_ AS (
  SELECT CAST(l.id + 1 + p.before_ + k AS BIGINT) AS order_id, CAST(l.day + 1 + p.day_no AS DATE) AS order_date
  FROM placed_ p, last_ l, unnest(range(p.n)) t(k)
),
buyers_ AS ({_numbered('b_customers', 'customer_id')}),
agents_ AS ({_numbered('b_employees', 'employee_id')}),
new_orders_ AS (
  SELECT m.order_id, c.customer_id, e.employee_id, m.order_date,
         CAST(m.order_date + {draw_int(draw(seed, 'req', o), *x.REQUIRED_DAYS)} AS DATE) AS required_date,
         CAST(m.order_date + {draw_int(draw(seed, 'ship', o), *x.SHIPPED_DAYS)} AS DATE) AS shipped_date,
         ({list(x.SHIP_VIAS)!r})[{draw_int(draw(seed, 'via', o), 1, len(x.SHIP_VIAS))}] AS ship_via,
         round({_between(draw(seed, 'freight', o), *x.FREIGHT)}, 2) AS freight,
         'Consignee ' || m.order_id AS ship_name, {draw_int(draw(seed, 'addr', o), 1, 999)} || ' Harbour Road' AS ship_address,
         'Newbridge' AS ship_city, CAST(NULL AS VARCHAR) AS ship_region,
         CAST({draw_int(draw(seed, 'zip', o), 10000, 99999)} AS VARCHAR) AS ship_postal_code, 'Nowhere' AS ship_country
  FROM made_ m
  JOIN buyers_ c ON c.idx = floor({draw(seed, 'cust', o)} * (SELECT count(*) FROM b_customers))
  JOIN agents_ e ON e.idx = floor({draw(seed, 'emp', o)} * (SELECT count(*) FROM b_employees))
)"""


def synthetic_lines_ctes(x) -> str:
    """The lines of those orders: the first draws that differ, one per line."""
    seed, o, most = x.DEFAULTS["seed"], "order_id", x.DEFAULTS["max_lines"]
    key = ("order_id", "line")
    return synthetic_orders_ctes(x) + f""",
goods_ AS ({_numbered('(SELECT product_id, unit_price FROM b_products)', 'product_id')}),
goods_n_ AS (SELECT count(*) AS np FROM goods_),
drawn_ AS (
  SELECT order_id, i, np, CAST(floor({draw(seed, 'prod', o, 'i')} * np) AS BIGINT) AS pi
  FROM new_orders_, goods_n_, range(1, {8 * most + 1}) t(i)
),
filled_up_ AS (
  SELECT order_id, i, pi FROM drawn_
  UNION ALL
  SELECT order_id, {8 * most} + j, (pi + j - 1) % np FROM drawn_, range(1, {most + 1}) t(j) WHERE i = 1
),
firsts_ AS (SELECT order_id, pi, min(i) AS i FROM filled_up_ GROUP BY ALL),
lines_ AS (SELECT order_id, pi, row_number() OVER (PARTITION BY order_id ORDER BY i) - 1 AS line FROM firsts_),
wanted_ AS (
  SELECT l.*, coalesce(g.unit_price, 0) AS base, g.product_id
  FROM lines_ l JOIN goods_ g ON g.idx = l.pi, goods_n_
  WHERE line < least({draw_int(draw(seed, 'lines', o), 1, most)}, np)
),
new_lines_ AS (
  SELECT order_id, product_id,
         CASE WHEN base > 0 THEN round(base * {_between(draw(seed, 'price', *key), *x.PRICE_FACTOR)}, 2)
              ELSE round({_between(draw(seed, 'price', *key), *x.BASE_PRICE)}, 2) END AS unit_price,
         {draw_int(draw(seed, 'qty', *key), *x.QUANTITY)} AS quantity,
         CAST(({list(x.DISCOUNTS)!r})[{draw_int(draw(seed, 'disc', *key), 1, len(x.DISCOUNTS))}] AS DOUBLE) AS discount
  FROM wanted_
)"""
