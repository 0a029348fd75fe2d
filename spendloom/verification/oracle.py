"""SQL that computes each query's result another way, for an ordinary SQL engine."""

from __future__ import annotations

from spendloom.functions.names import similar_names, standard_names
from spendloom.operators.columns import NUMBERED_NAMES
from spendloom.verification.queries import SCOPE

#: The years in the test tables; SQL needs its columns named.
YEARS = range(1995, 2002)

_SCOPE = ", ".join(f"'{c}'" for c in SCOPE)
_SPACES = "' ' || chr(9) || chr(10) || chr(13)"

PURCHASES = r"""purchases AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year_authorization,
         CAST(l_suppkey AS VARCHAR) AS uniquevendorcode,
         l_linestatus AS warehouse,
         CAST(l_partkey AS VARCHAR) AS product_number,
         p_name AS product_description,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS purchase_amount_eur,
         l_quantity AS purchase_quantity,
         s_name AS crm_main_vendor,
         nullif(n_name, 'NATION_7') AS crm_main_group_vendor,
         ' ' || CAST(p_size // 10 AS VARCHAR) || ' - ' || p_type AS class2,
         p_type AS class3,
         p_brand AS class4,
         ' ' || upper(split_part(p_name, ' ', 1)) || chr(9) AS brand_name,
         l_returnflag AS brand_type,
         n_name AS country_of_origin,
         CASE WHEN l_shipdate >= TIMESTAMP '2001-09-01' THEN 'N' ELSE 'Y' END AS purchase_stop_ind
  FROM lineitem
  JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey)"""

SPEND = """spend AS (
  SELECT p_brand AS class4, CAST(p_partkey AS VARCHAR) AS product_number, p_name AS product_description,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS purchase_amount_eur
  FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE p_brand IS NOT NULL AND p_name IS NOT NULL
  GROUP BY ALL)"""

CREDITS = """credits AS (
  SELECT n_name AS class4, CAST(c_custkey AS VARCHAR) AS product_number, c_acctbal AS balance
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def _tiers(source: str, spend: str, labels: str, cuts: list[str], minimum: int, name: str = "tiers",
           ties: str = "product_number, product_description", money_type: str = "DECIMAL(28,2)") -> str:
    """Tiering as plain windows over `source`."""
    money = f"CAST({spend} AS {money_type})"
    arms = " ".join(f"WHEN running <= {cut} * total THEN '{label}'" for label, cut in zip(labels, cuts))
    last = labels[-1]
    return f"""{name}_run AS (
  SELECT *, CAST(sum({money}) OVER (PARTITION BY class4 ORDER BY {money} DESC NULLS LAST, {ties}
                               ROWS UNBOUNDED PRECEDING) AS {money_type}) AS running,
         CAST(coalesce(sum({money}) OVER (PARTITION BY class4), 0) AS {money_type}) AS total
  FROM {source}),
{name}_raw AS (
  SELECT *, CASE WHEN total > 0 AND {spend} IS NOT NULL
                 THEN CAST(running AS DOUBLE) / CAST(total AS DOUBLE) END AS cum_share,
         CASE WHEN total <= 0 THEN '{last}' WHEN {spend} IS NULL THEN 'nan' {arms}
              WHEN running <= total THEN '{last}' ELSE 'nan' END AS raw_label
  FROM {name}_run),
{name} AS (
  SELECT * EXCLUDE (running, total, raw_label),
         CASE WHEN raw_label <> 'nan' AND count(*) OVER (PARTITION BY class4, raw_label) < {minimum}
              THEN '{last}' ELSE raw_label END AS segmentation
  FROM {name}_raw)"""


TIERS = SPEND + ",\n" + _tiers("spend", "purchase_amount_eur", "ABCDE", ["0.8", "0.95", "0.99", "0.999"], 5)
CREDIT_TIERS = CREDITS + ",\n" + _tiers(
    "credits", "balance", "ABCDE", ["0.8", "0.95", "0.99", "0.999"], 0, ties="product_number"
)
ABC = SPEND + ",\n" + _tiers("spend", "purchase_amount_eur", "ABC", ["0.8", "0.95"], 0)

_EUR = "CAST(purchase_amount_eur AS DOUBLE) AS purchase_amount_eur"
_TIER_ROWS = f"SELECT * REPLACE ({_EUR}) FROM tiers"

STOP = """stop_flags AS (
  SELECT p.product_number, min(f.flag) AS purchase_stop_ind
  FROM (SELECT CAST(l_partkey AS VARCHAR) AS product_id, l_suppkey,
               CASE WHEN l_shipdate >= TIMESTAMP '2001-09-01' THEN 'N' ELSE 'Y' END AS flag FROM lineitem) f
  LEFT JOIN (SELECT CAST(p_partkey AS VARCHAR) AS product_id, CAST(p_partkey AS VARCHAR) AS product_number
             FROM part) p ON p.product_id = f.product_id
  LEFT JOIN (SELECT s_suppkey, CASE WHEN s_nationkey < 20 THEN 'Acme ' ELSE 'Other ' END || s_name AS name
             FROM supplier) c ON c.s_suppkey = f.l_suppkey
  WHERE c.name LIKE 'Acme %'
  GROUP BY 1)"""

BRANDS = """brand_ids AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_number, p_brand AS key_brand_identifier FROM part
  UNION ALL
  SELECT CAST(p_partkey AS VARCHAR), p_brand || '-B' FROM part WHERE p_size % 5 = 0)"""

ROUNDING = """rounding AS (
  SELECT CAST(l_partkey AS VARCHAR) AS product_number, min(CAST(l_linenumber % 3 AS VARCHAR)) AS sales_rounding
  FROM lineitem GROUP BY 1)"""

SCOPED = rf"""scoped AS (
  SELECT * FROM purchases
  WHERE crm_main_group_vendor IS NOT NULL AND year_authorization > 1996
    AND regexp_extract(class2, '^\s*(\d+)', 1) = '2'
    AND lower(trim(brand_name, {_SPACES})) = 'red'
    AND lower(trim(class4, {_SPACES})) IN ({_SCOPE})
    AND NOT regexp_matches(product_number, '01$'))"""

ITEMS = """item_scope AS (
  SELECT DISTINCT 'ticGoldenItem-' || CAST(i.p_partkey AS VARCHAR) AS item_id,
         CAST(i.p_partkey AS VARCHAR) AS item_number, i.p_name AS item_description,
         i.p_brand AS key_brand_identifier, CAST(i.p_size % 3 AS VARCHAR) AS rounding,
         'Y' AS publishable_in_country, i.p_type AS item_segment,
         h.class4_number, h.class4_description, h.class3_number, h.class3_description,
         h.class2_number, h.class2_description,
         CASE h.num % 5 WHEN 0 THEN 'Global' WHEN 1 THEN 'Local' WHEN 2 THEN 'OE' WHEN 3 THEN 'Private label'
         END AS brand_type_step,
         CASE WHEN i.p_name LIKE '%bolt%' AND h.class3_description = 'Bolts & Nuts' AND i.p_size % 2 = 0
                   AND i.p_size % 9 <> 0
              THEN CAST(CAST(i.p_size AS VARCHAR) || '.5' AS DOUBLE) END AS dimension_per_product_type
  FROM part i
  JOIN (SELECT p_brand AS class4_number, 'Class ' || p_brand AS class4_description, num,
               CAST(num % 2 AS VARCHAR) AS class3_number,
               CASE WHEN num % 2 = 0 THEN 'Bolts & Nuts' ELSE 'Washers' END AS class3_description,
               CAST(num % 3 AS VARCHAR) AS class2_number,
               CASE WHEN num % 3 <> 0 THEN '54 - Fasteners' ELSE '60 - Other' END AS class2_description
        FROM (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS num FROM part)) h
    ON h.class4_number = i.p_brand
  WHERE i.p_size % 7 <> 0 AND h.class2_description = '54 - Fasteners')"""

SALES = """sales AS (
  SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(l_orderkey AS VARCHAR) END AS order_number,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              AS DECIMAL(18,2)) AS turnover_euro,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS list_price_turnover_euro,
         l_quantity AS quantity_sold, CAST(c_custkey AS VARCHAR) AS customer_id, c_mktsegment AS segment,
         CAST(l_partkey AS VARCHAR) AS product_number, l_linenumber AS line_number,
         CAST(year(o_orderdate) AS INTEGER) AS year_number,
         CASE l_linenumber WHEN 1 THEN 'Global A' WHEN 2 THEN 'Local B' WHEN 3 THEN 'OE'
           WHEN 4 THEN 'Private label C' WHEN 5 THEN 'Non branded' WHEN 6 THEN 'Unknown type' END AS brand_type
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
sales_m AS (
  SELECT *, CAST(turnover_euro - CAST(CAST(list_price_turnover_euro AS DECIMAL(18,3)) * 0.5 AS DECIMAL(18,2))
                 AS DECIMAL(18,2)) AS margin_euro FROM sales)"""

_GROUP = """CASE brand_type WHEN 'Global A' THEN 'Global' WHEN 'Local B' THEN 'Local' WHEN 'OE' THEN 'OE'
  WHEN 'Private label C' THEN 'Private label' WHEN 'Non branded' THEN 'Other' END"""

VALUES = """eav AS (
  SELECT CASE WHEN l_discount = 0 THEN '' ELSE 'ticGoldenItem-' END || CAST(l_partkey AS VARCHAR) AS id,
         CASE l_linenumber WHEN 1 THEN 'attItemNumber' WHEN 2 THEN 'attUnit' WHEN 3 THEN 'taMat_3'
           WHEN 4 THEN 'taLen_4' WHEN 5 THEN 'attThreadType' WHEN 6 THEN 'taThread_6' WHEN 7 THEN 'attOther'
         END AS attribute_id,
         CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'Ж' || l_returnflag
              WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN '   '
              ELSE ' ' || l_returnflag || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS value
  FROM lineitem),
clean AS (
  SELECT id, attribute_id, trim(value) AS value FROM eav
  WHERE regexp_full_match(value, '[A-Za-z0-9 ,./()%+-]+') AND trim(value) <> '')"""

_DETAIL_COLUMNS = (
    "unit", "head_shape", "thread_type", "head_height", "head_outside_diameter_width", "quality",
    "surface_treatment", "material", "din_standard", "weight_per_100_pcs", "content_in_sales_unit",
    "thread_diameter", "length", "height", "total_height", "width", "iso_standard", "inside_diameter",
    "outside_diameter", "thickness", "designed_for_thread", "total_length", "head_type", "thread_length",
)
_FED = {"unit": "attUnit", "material": "taMat_3", "length": "taLen_4", "thread_diameter": "taThread_6"}


def _max_of(attribute: str) -> str:
    return f"max(CASE WHEN attribute_id = '{attribute}' THEN value END)"


_PRODUCT_COLUMNS = ", ".join(
    [f"{_max_of('attItemNumber')} AS product_number"]
    + [
        f"{_max_of(_FED[c]) if c in _FED else 'CAST(NULL AS VARCHAR)'} AS {c}"
        for c in _DETAIL_COLUMNS
    ]
)

LOCAL = r"""local AS (
  SELECT CASE l_linenumber WHEN 1 THEN 'taHeadShape' WHEN 2 THEN 'taMaterial_2' WHEN 3 THEN 'taMaterial_40'
           WHEN 4 THEN 'taSurfaceThreatment_11' WHEN 5 THEN 'taSurfaceTreatment_4' WHEN 6 THEN 'taThreadType_'
           WHEN 7 THEN 'taOther' END AS attribute_id,
         CAST(l_partkey AS VARCHAR) AS item_number,
         CASE WHEN l_linestatus = 'F' THEN 'ENG' ELSE 'NLD' END AS language_id,
         CASE WHEN l_quantity <> 13 THEN l_returnflag || CAST(CAST(l_quantity AS INTEGER) % 5 AS VARCHAR) END AS value
  FROM lineitem),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(attribute_id, '^ta', ''), '_[0-9]+$', ''), '_$', '')
         AS attr_key FROM local)"""


def _enriched(language: str) -> str:
    """Attribute columns per product, as the list of their values."""
    columns = {
        "connection_type": "ConnectionType",
        "for_strap_bolt": "ForStrapBolt",
        "head_shape": "HeadShape",
        "head_type": "HeadType",
        "label_colour_code": "LabelColourCode",
        "material": "Material",
        "measurements_type": "MeasurementsType",
        "new_treatment": "SurfaceTreatment",
        "old_treatment": "SurfaceThreatment",
        "thread_direction": "ThreadDirection",
        "thread_type": "ThreadType",
        "type": "Type",
    }
    lists = ", ".join(
        f"string_agg(DISTINCT value, ' | ' ORDER BY value) FILTER (attr_key = '{key}') AS {name}"
        for name, key in columns.items()
    )
    return f"""lists AS (
  SELECT item_number AS product_number, {lists} FROM keyed
  WHERE language_id = '{language}' AND attribute_id <> 'taOther' GROUP BY 1),
attrs AS (
  SELECT * EXCLUDE (new_treatment, old_treatment),
         CASE WHEN new_treatment <> old_treatment THEN new_treatment || ' | ' || old_treatment
              ELSE coalesce(new_treatment, old_treatment) END AS surface_treatment
  FROM lists)"""


YEAR_ROWS = f"""year_rows AS (
  SELECT product_number, min(product_description) AS product_description, class4,
         year_authorization AS year, sum(purchase_quantity) AS purchase_quantity
  FROM purchases WHERE lower(class4) IN ({_SCOPE})
  GROUP BY product_number, class4, year_authorization)"""

SEGMENTS = """segments AS (
  SELECT product_number, arg_min(product_description, (product_description, segmentation)) AS product_description,
         arg_min(segmentation, (product_description, segmentation)) AS segmentation
  FROM tiers GROUP BY product_number)"""

_YEAR_SUMS = ", ".join(
    f"coalesce(sum(purchase_quantity) FILTER (year = {y}), 0) AS purchase_quantity_{y}" for y in YEARS
)
_YEAR_INTS = ", ".join(
    f"CAST(round_even(coalesce(sum(purchase_quantity) FILTER (year = {y}), 0), 0) AS BIGINT) AS purchase_quantity_{y}"
    for y in YEARS
)

SPLIT = f"""split AS (
  SELECT product_number, arg_min(class4, (year, class4)) AS class4, {_YEAR_INTS}
  FROM year_rows GROUP BY product_number)"""

YEAR_SPLIT_ROWS = "SELECT s.*, g.product_description, g.segmentation FROM split s LEFT JOIN segments g USING (product_number)"


def _metric_columns() -> str:
    parts = []
    for y in YEARS:
        for source, prefix in (
            ("turnover_euro", "turnover_eur"),
            ("quantity_sold", "quantity_sold"),
            ("margin_euro", "margin_gross_eur"),
            ("list_price_turnover_euro", "list_price_turnover_eur"),
        ):
            parts.append(f"CAST(coalesce(sum({source}) FILTER (year_number = {y}), 0) AS DOUBLE) AS {prefix}_{y}")
        parts.append(f"count(DISTINCT order_number) FILTER (year_number = {y}) AS orders_{y}")
    return ", ".join(parts)


PRODUCT_YEARS = """product_years AS (
  SELECT product_number, year_number, sum(turnover_euro) AS turnover, sum(quantity_sold) AS quantity,
         sum(margin_euro) AS margin, count(DISTINCT order_number) AS orders
  FROM sales_m GROUP BY 1, 2)"""

DETAILS = """long AS (
  SELECT CASE WHEN l_partkey % 2 = 0 THEN 'ticArticle-' ELSE 'ticGoldenItem-' END || CAST(l_partkey AS VARCHAR)
           AS product_id, CAST(l_partkey AS VARCHAR) AS product_number,
         CASE l_linenumber WHEN 1 THEN 'Unit' WHEN 2 THEN 'Material' WHEN 3 THEN 'Head shape' WHEN 4 THEN 'Length'
           WHEN 5 THEN 'Colour' WHEN 6 THEN 'Colour' WHEN 7 THEN 'Finish' END AS detail_name,
         l_returnflag || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS detail_value
  FROM lineitem),
wanted AS (
  SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS product_number
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0),
asked AS (
  SELECT *, detail_name IN ('Unit', 'Material', 'Head shape', 'Length') AS known
  FROM long JOIN wanted USING (product_number) WHERE detail_name IS NOT NULL),
details AS (
  SELECT product_number, detail_name, min(detail_value) AS detail_value
  FROM asked JOIN (SELECT product_number, bool_or(known) AS any_known FROM asked GROUP BY 1) USING (product_number)
  WHERE known OR NOT any_known GROUP BY 1, 2)"""

#: The same where a third of the values are missing and a third are blank.
SPARSE_DETAILS = DETAILS.replace(
    "l_returnflag || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS detail_value",
    "CASE WHEN CAST(l_quantity AS INTEGER) % 3 = 2 THEN l_returnflag || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS detail_value",
).replace("WHERE detail_name IS NOT NULL)", "WHERE detail_name IS NOT NULL AND detail_value IS NOT NULL)")

WIDE = """wide AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_number, 'Material' AS detail_name,
         CASE WHEN p_size % 4 <> 0 THEN p_type END AS detail_value FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'Head height',
         CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS VARCHAR) END FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'DIN Standard', p_name FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'Brand Name', p_brand FROM part)"""

_DETAIL_NAMES = (
    "Unit", "Head shape", "Thread type", "Head height", "Head outside diameter (width)", "Quality",
    "Surface treatment", "Material", "DIN Standard", "Weight per 100 pcs", "Content in sales unit",
    "Thread diameter", "Length", "Height", "Total height", "Width", "ISO Standard", "Inside diameter",
    "Outside diameter", "Thickness", "Designed for thread", "Total length", "Head type", "Thread length",
)


def _histogram(column: str) -> str:
    return f"""WITH b AS (SELECT min({column}) AS lo, max({column}) AS hi, (max({column}) - min({column})) / 50 AS w
  FROM lineitem),
c AS (SELECT least(CAST(floor(({column} - lo) / w) AS INTEGER), 49) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, round(lo + r.bin * w, 4) AS low, round(lo + (r.bin + 1) * w, 4) AS high,
       coalesce(n, 0) AS rows
FROM (SELECT unnest(range(50)) AS bin) r JOIN b ON true LEFT JOIN c ON c.bin = r.bin"""


_DESCRIBE = """SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean,
  round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min,
  round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, max(l_extendedprice) AS max FROM lineitem"""

_PURCHASE_COLUMNS = (
    "year_authorization", "uniquevendorcode", "warehouse", "product_number", "product_description",
    "purchase_amount_eur", "purchase_quantity", "crm_main_vendor", "crm_main_group_vendor", "class2", "class3",
    "class4", "brand_name", "brand_type", "country_of_origin", "purchase_stop_ind",
)
_KEYS = ", ".join(
    c
    for c in _PURCHASE_COLUMNS
    if c not in ("uniquevendorcode", "warehouse", "purchase_amount_eur", "purchase_quantity")
)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _title(name: str) -> str:
    return " ".join(w.capitalize() for w in name.split("_"))

FOUR = """four_spend AS (
  SELECT p_brand AS class4, CAST(p_partkey AS VARCHAR) AS product_number, d AS product_description, purchase_amount_eur
  FROM part JOIN (SELECT l_partkey, sum(CAST(l_tax * l_discount AS DECIMAL(18,4))) AS purchase_amount_eur
                  FROM lineitem GROUP BY 1) ON l_partkey = p_partkey, unnest([p_name, p_type]) AS u(d))"""
FOUR_TIERS = FOUR + ",\n" + _tiers(
    "four_spend", "purchase_amount_eur", "ABCDE", ["0.8", "0.95", "0.99", "0.999"], 5, money_type="DECIMAL(28,4)"
)

#: Steps of the logarithm of spend, as `operators.clustering.RESOLUTION` has them, and their best split into five.
_STEP = "CASE WHEN purchase_amount_eur > 0 THEN CAST(floor(ln(CAST(purchase_amount_eur AS DOUBLE)) * 256) AS BIGINT) END"


def _split_steps(clusters: int = 5) -> str:
    """The place of the first step of each cluster, `starts(j, i)`, by trying every split of counted steps."""
    parts = [
        f"""logged AS (SELECT {_STEP} AS b FROM spend),
bins AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY b) AS i, b, n, sum(n) OVER (ORDER BY b) AS w, sum(n * b) OVER (ORDER BY b) AS s, sum(n * b * b) OVER (ORDER BY b) AS q
  FROM (SELECT b, count(*)::HUGEINT AS n FROM logged WHERE b IS NOT NULL GROUP BY 1)),
split1 AS MATERIALIZED (SELECT i, (q - s * s / w::DOUBLE)::DOUBLE AS c, 1::BIGINT AS m FROM bins)"""
    ]
    for j in range(2, clusters + 1):
        parts.append(
            f"""split{j} AS MATERIALIZED (
  SELECT i, best.c AS c, best.m AS m FROM (
    SELECT e.i, min({{'c': l.c + greatest((e.q - p.q) - (e.s - p.s) * (e.s - p.s) / (e.w - p.w)::DOUBLE, 0), 'm': p.i + 1}}) AS best
    FROM split{j - 1} l JOIN bins p ON p.i = l.i JOIN bins e ON e.i > p.i GROUP BY e.i))"""
        )
    starts = "(SELECT max(i) FROM bins)"
    steps = []
    for j in range(clusters, 0, -1):
        parts.append(f"start{j} AS MATERIALIZED (SELECT {j} AS j, m AS i FROM split{j} WHERE i = {starts})")
        starts = f"(SELECT i - 1 FROM start{j})"
        steps.append(f"SELECT j, i FROM start{j}")
    parts.append("starts AS MATERIALIZED (SELECT j, starts.i, b AS first FROM (" + " UNION ALL ".join(steps) + ") starts JOIN bins ON bins.i = starts.i)")
    return ",\n".join(parts)


def _mixture(steps: int = 40) -> str:
    """Parts of a normal mixture, `mix(j, share, mean, variance)`, after so many steps from the split."""
    parts = [
        """belongs0 AS MATERIALIZED (
  SELECT s.j, b.b / 256.0::DOUBLE AS x, b.n::DOUBLE AS n, (s.j = (SELECT max(t.j) FROM starts t WHERE t.i <= b.i))::INT::DOUBLE AS r
  FROM bins b, starts s)"""
    ]
    for step in range(steps + 1):
        parts.append(
            f"""mix{step} AS MATERIALIZED (
  SELECT j, greatest(sum(r * n), 1e-12) / sum(n) AS share, sum(r * n * x) / greatest(sum(r * n), 1e-12) AS mean,
         greatest(sum(r * n * x * x) / greatest(sum(r * n), 1e-12) - pow(sum(r * n * x) / greatest(sum(r * n), 1e-12), 2), 1e-4) AS variance
  FROM belongs{step} GROUP BY j),
belongs{step + 1} AS MATERIALIZED (
  SELECT j, x, n, d / greatest(sum(d) OVER (PARTITION BY x), 1e-300) AS r
  FROM (SELECT m.j, x, n, share / sqrt(variance) * exp(-pow(x - mean, 2) / (2 * variance)) AS d
        FROM belongs0 b JOIN mix{step} m ON m.j = b.j))"""
        )
    parts.append(f"mix AS (SELECT *, row_number() OVER (ORDER BY mean DESC, j) AS rank FROM mix{steps})")
    return ",\n".join(parts)


_KMEANS_ROWS = f"""SELECT * REPLACE (CAST(purchase_amount_eur AS DOUBLE) AS purchase_amount_eur),
  coalesce('EDCBA'[(SELECT max(j) FROM starts WHERE first <= {_STEP})], 'E') AS segmentation FROM spend"""
_GMM_ROWS = f"""SELECT * EXCLUDE (x) REPLACE (CAST(purchase_amount_eur AS DOUBLE) AS purchase_amount_eur),
  coalesce('ABCDE'[(SELECT arg_max(rank, ln(share) - ln(variance) / 2 - pow(x - mean, 2) / (2 * variance)) FROM mix)], 'E') AS segmentation
FROM (SELECT *, {_STEP} / 256.0::DOUBLE AS x FROM spend)"""


def _clusters(candidates: tuple[int, ...] = (2, 3, 4), steps: int = 30) -> str:
    """K-means of scaled spend and quantity from far points of a sample, for the best number by silhouette."""
    parts = [
        """f AS (SELECT product_number, CAST(sum(purchase_amount_eur) AS DOUBLE) AS spend, sum(purchase_quantity) AS quantity
  FROM purchases GROUP BY 1),
z AS MATERIALIZED (
  SELECT product_number, (spend - avg(spend) OVER ()) / stddev_samp(spend) OVER () AS a,
         (quantity - avg(quantity) OVER ()) / stddev_samp(quantity) OVER () AS b FROM f),
sample AS MATERIALIZED (SELECT a, b FROM z ORDER BY md5(product_number) LIMIT 1000),
far1 AS MATERIALIZED (SELECT 0 AS j, a, b FROM sample ORDER BY a * a + b * b, a, b LIMIT 1)"""
    ]
    for j in range(1, max(candidates)):
        parts.append(
            f"""far{j + 1} AS MATERIALIZED (SELECT * FROM far{j} UNION ALL SELECT * FROM (SELECT {j}, p.a, p.b FROM sample p, far{j} c
  GROUP BY p.a, p.b ORDER BY min(pow(p.a - c.a, 2) + pow(p.b - c.b, 2)) DESC, p.a, p.b LIMIT 1))"""
        )
    near = "(SELECT p.product_number, p.a, p.b, arg_min(c.j, {{'d': pow(p.a - c.a, 2) + pow(p.b - c.b, 2), 'j': c.j}}) AS j FROM z p, {0} c GROUP BY ALL)"
    for k in candidates:
        parts.append(f"c{k}_0 AS MATERIALIZED (SELECT j, a, b FROM far{k})")
        for step in range(steps):
            parts.append(
                f"""c{k}_{step + 1} AS MATERIALIZED (SELECT c.j, coalesce(avg(n.a), any_value(c.a)) AS a, coalesce(avg(n.b), any_value(c.b)) AS b
  FROM c{k}_{step} c LEFT JOIN {near.format(f'c{k}_{step}')} n ON n.j = c.j GROUP BY c.j)"""
            )
        parts.append(
            f"""in{k} AS MATERIALIZED {near.format(f'c{k}_{steps}')},
sums{k} AS MATERIALIZED (SELECT j, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(a * a + b * b) AS q FROM in{k} GROUP BY j),
away{k} AS (
  SELECT p.product_number, max(CASE WHEN s.j = p.j AND n > 1 THEN d * n / (n - 1) END) AS own, min(CASE WHEN s.j <> p.j THEN d END) AS other
  FROM (SELECT p.product_number, p.j AS pj, s.j, s.n, p.a * p.a + p.b * p.b + s.q - 2 * (p.a * s.a + p.b * s.b) AS d FROM in{k} p, sums{k} s) s
  JOIN in{k} p USING (product_number) GROUP BY 1),
score{k} AS MATERIALIZED (
  SELECT {k} AS k, round(avg(CASE WHEN own IS NULL OR greatest(own, other) <= 0 THEN 0 ELSE (other - own) / greatest(own, other) END), 9) AS score FROM away{k})"""
        )
    scores = " UNION ALL ".join(f"SELECT * FROM score{k}" for k in candidates)
    parts.append(f"best AS MATERIALIZED (SELECT k FROM ({scores}) ORDER BY score DESC, k LIMIT 1)")
    rows = " UNION ALL ".join(
        f"SELECT product_number, cluster FROM in{k} JOIN (SELECT j, CAST(rank() OVER (ORDER BY a, b) - 1 AS INTEGER) AS cluster FROM c{k}_{steps})"
        f" USING (j) WHERE (SELECT k FROM best) = {k}"
        for k in candidates
    )
    return ",\n".join(parts) + "\n" + rows


ODD_DETAILS = """odd AS (
  SELECT product_number, detail_value, product_id FROM long JOIN wanted USING (product_number))"""


def _missing() -> str:
    """Missing values of the preprocessed purchases: nearly equal names count as one column."""
    names = standard_names(_PURCHASE_COLUMNS)
    groups = similar_names(names, 0.8, NUMBERED_NAMES)
    absorbed = {n for others in groups.values() for n in others}
    source = dict(zip(names, _PURCHASE_COLUMNS))
    rows = []
    for name in names:
        if name not in absorbed:
            columns = ", ".join(f"CAST({source[n]} AS VARCHAR)" for n in (name, *groups.get(name, [])))
            rows.append(f"SELECT '{name}' AS column_name, count(*) - count(coalesce({columns})) AS missing FROM purchases")
    return " UNION ALL ".join(rows)



_REPORT_TABLES = (
    _with(PURCHASES, TIERS, YEAR_ROWS, SEGMENTS, SPLIT)
    + """SELECT 'product_spend' AS name, count(*) AS rows, round(CAST(sum(purchase_amount_eur) AS DOUBLE), 2) AS total FROM spend
UNION ALL SELECT 'tiers', count(*), round(CAST(sum(purchase_amount_eur) AS DOUBLE), 2) FROM tiers
UNION ALL SELECT 'purchases', count(*), round(CAST(sum(p.purchase_amount_eur) AS DOUBLE), 2)
  FROM purchases p LEFT JOIN tiers t USING (product_number)
UNION ALL SELECT 'summary', count(DISTINCT (class4, segmentation)), round(CAST(sum(purchase_amount_eur) AS DOUBLE), 2) FROM tiers
UNION ALL SELECT 'reconciliation', 1, round(CAST(sum(purchase_amount_eur) AS DOUBLE), 2) FROM purchases
UNION ALL SELECT 'year_quantity', count(*), round(CAST(sum(purchase_quantity) AS DOUBLE), 2) FROM year_rows
UNION ALL SELECT 'year_split', count(*), NULL FROM split"""
)

ORACLE: dict[str, str] = {
    "tiers_four_decimals": _with(FOUR_TIERS)
    + "SELECT * REPLACE (CAST(purchase_amount_eur AS DOUBLE) AS purchase_amount_eur) FROM tiers",
    "kmeans_tiers": _with(SPEND, _split_steps()) + _KMEANS_ROWS,
    "gmm_tiers": _with(SPEND, _split_steps(), _mixture()) + _GMM_ROWS,
    "product_clusters": _with(PURCHASES, _clusters()),
    "report_tables": _REPORT_TABLES,
    "staged_report_tables": _REPORT_TABLES,
    "detail_fetch_discovered": _with(DETAILS)
    + """SELECT product_number, 'Odd ' || (l_name % 13) AS detail_name, min(detail_value) AS detail_value
FROM (SELECT product_number, detail_value, length(detail_value) * 7 + ascii(detail_value) + ascii(right(detail_value, 1)) AS l_name
      FROM long JOIN wanted USING (product_number)) GROUP BY 1, 2""",
    "detail_fetch_mixed": _with(DETAILS)
    + """SELECT CAST(p_partkey AS VARCHAR) AS product_number, d.n AS detail_name, d.v AS detail_value
FROM part JOIN wanted ON product_number = CAST(p_partkey AS VARCHAR),
     unnest([{'n': 'size', 'v': CAST(p_size AS VARCHAR)}, {'n': 'make', 'v': p_brand}]) AS u(d)
WHERE p_partkey % 3 = 0 AND d.v IS NOT NULL
UNION ALL SELECT * FROM details WHERE CAST(product_number AS BIGINT) % 3 <> 0""",
    "number_text": """SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 1) OR c_custkey % 5 IN (0, 1) THEN 0.0
  WHEN c_custkey % 5 = 3 THEN c_nationkey * 10.0 ELSE CAST(c_nationkey AS DOUBLE) END AS total_spend FROM customer""",
    "odd_space_scope": f"SELECT p_partkey, p_brand AS class4 FROM part WHERE lower(p_brand) IN ({_SCOPE})",
    "harmonize_mixed": """SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS brand_name FROM part""",
    "renamed_columns": "SELECT p_partkey, p_name AS name, p_brand AS class3 FROM part",
    "preprocess_report": _with(PURCHASES) + _missing(),
    "tiers_narrow": _with(
        """narrow AS (
  SELECT 'one' AS class4, CAST(l_orderkey AS VARCHAR) AS product_number,
         CAST(10 + CAST(sum(l_linenumber) * 1009 + l_orderkey % 997 AS DECIMAL(18,6)) / 1000000 AS DECIMAL(18,6)) AS purchase_amount_eur
  FROM lineitem GROUP BY l_orderkey)""",
        _tiers("narrow", "purchase_amount_eur", "ABCDE", ["0.8", "0.95", "0.99", "0.999"], 5, ties="product_number", money_type="DECIMAL(28,6)"),
    )
    + _TIER_ROWS,
    "tiers_equal": _with(
        """equal AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'one' ELSE o_orderpriority END AS class4, 'item-' || o_orderkey AS product_number,
         CAST(10 AS DECIMAL(18,2)) AS purchase_amount_eur FROM orders)""",
        _tiers("equal", "purchase_amount_eur", "ABCDE", ["0.8", "0.95", "0.99", "0.999"], 5, ties="product_number"),
    )
    + _TIER_ROWS,
    "abcde_tiers": _with(TIERS) + _TIER_ROWS,
    "abcde_tiers_blocks": _with(TIERS) + _TIER_ROWS,
    "abc_tiers": _with(ABC) + _TIER_ROWS,
    "min_population": _with(TIERS) + _TIER_ROWS,
    "cum_share": _with(TIERS) + f"SELECT * EXCLUDE (segmentation) REPLACE ({_EUR}) FROM tiers",
    "credit_tiers": _with(CREDIT_TIERS) + "SELECT * FROM tiers",
    "credit_tiers_blocks": _with(CREDIT_TIERS) + "SELECT * FROM tiers",
    "product_spend": _with(PURCHASES)
    + """SELECT class4, product_number, product_description,
  CAST(sum(purchase_amount_eur) AS DOUBLE) AS purchase_amount_eur FROM purchases GROUP BY 1, 2, 3""",
    "tier_counts": _with(TIERS) + "SELECT class4, segmentation, count(*) AS products FROM tiers GROUP BY 1, 2",
    "tier_summary": _with(TIERS)
    + """SELECT class4, segmentation, count(DISTINCT product_number) AS products,
  CAST(sum(purchase_amount_eur) AS DOUBLE) AS spend_total,
  format('{:,}', count(DISTINCT product_number)) AS products_text,
  format('{:,} EUR', CAST(round_even(sum(purchase_amount_eur), 0) AS BIGINT)) AS spend_total_text
FROM tiers GROUP BY 1, 2""",
    "attach_segment": _with(PURCHASES, TIERS)
    + f"""SELECT p.* REPLACE (CAST(p.purchase_amount_eur AS DOUBLE) AS purchase_amount_eur), t.segmentation
FROM purchases p LEFT JOIN tiers t ON t.product_number = p.product_number""",
    "attach_segment_hot": _with(PURCHASES, TIERS)
    + f"""SELECT p.* REPLACE (CAST(p.purchase_amount_eur AS DOUBLE) AS purchase_amount_eur), t.segmentation
FROM (SELECT * REPLACE (CASE WHEN CAST(uniquevendorcode AS INTEGER) % 3 = 0 THEN '7' ELSE product_number END AS product_number)
      FROM purchases) p LEFT JOIN tiers t ON t.product_number = p.product_number""",
    "attach_segment_by_class": _with(PURCHASES, TIERS)
    + """SELECT p.class4, p.product_number, p.product_description,
  CAST(p.purchase_amount_eur AS DOUBLE) AS purchase_amount_eur, t.segmentation
FROM purchases p LEFT JOIN tiers t ON t.product_number = p.product_number AND t.class4 = p.class4""",
    "reconcile": _with(TIERS)
    + """SELECT CAST(raw AS DOUBLE) AS raw_total, CAST(summary AS DOUBLE) AS summary_total,
  CAST(summary - raw AS DOUBLE) AS difference, abs(summary - raw) <= 1e-8 + 1e-5 * abs(raw) AS matches
FROM (SELECT sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS raw FROM lineitem),
     (SELECT sum(purchase_amount_eur) AS summary FROM tiers)""",
    "segmentation_report": _with(PURCHASES, TIERS, YEAR_ROWS, SEGMENTS, SPLIT) + YEAR_SPLIT_ROWS,
    "fetch_purchase": _with(PURCHASES)
    + f"""SELECT {_KEYS}, CAST(sum(purchase_amount_eur) AS DOUBLE) AS purchase_amount_eur,
  sum(purchase_quantity) AS purchase_quantity
FROM purchases WHERE lower(trim(class4)) IN ({_SCOPE}) GROUP BY {_KEYS}""",
    "scoped_sample": _with(PURCHASES)
    + f"""SELECT least(count(*), 1000) AS rows, least(count(*), 1000) AS rows_in_scope FROM purchases
WHERE lower(class4) IN ({_SCOPE})""",
    "clustering_fetch": _with(PURCHASES)
    + """SELECT product_number, CAST(purchase_amount_eur AS DOUBLE) AS purchase_amount_eur, purchase_quantity FROM purchases
WHERE class3 IN ('PROMO', 'SMALL') AND brand_name = ' RED' || chr(9) AND product_number IS NOT NULL
  AND purchase_amount_eur IS NOT NULL AND purchase_quantity IS NOT NULL""",
    "year_groups": """SELECT measure, string_agg(measure || '_' || y, ',' ORDER BY y) AS year_columns
FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
     (VALUES ('turnover_eur'), ('orders')) AS m(measure) GROUP BY 1""",
    "super_table": _with(PURCHASES)
    + f"""SELECT * REPLACE ({_EUR}) FROM purchases
WHERE class3 IN ('PROMO', 'SMALL') AND brand_name = ' RED' || chr(9)""",
    "purchase_build": _with(PURCHASES, SCOPED, BRANDS, STOP, ROUNDING)
    + f"""SELECT s.* EXCLUDE (purchase_stop_ind) REPLACE (CAST(s.purchase_amount_eur AS DOUBLE) AS purchase_amount_eur),
  b.key_brand_identifier, f.purchase_stop_ind, r.sales_rounding
FROM scoped s
LEFT JOIN (SELECT DISTINCT i.* FROM brand_ids i JOIN scoped USING (product_number)) b USING (product_number)
LEFT JOIN stop_flags f USING (product_number)
LEFT JOIN rounding r USING (product_number)
WHERE f.purchase_stop_ind = 'N'""",
    "brand_map": _with(PURCHASES, SCOPED, BRANDS)
    + "SELECT DISTINCT b.* FROM brand_ids b JOIN scoped s ON s.product_number = b.product_number",
    "stop_flag": _with(STOP) + "SELECT * FROM stop_flags",
    "any_lookup": _with(ROUNDING) + "SELECT * FROM rounding",
    "dedup_first": _with(PURCHASES)
    + """SELECT * EXCLUDE (n) FROM (
  SELECT product_number, year_authorization, uniquevendorcode, purchase_quantity,
         CAST(purchase_amount_eur AS DOUBLE) AS purchase_amount_eur,
         row_number() OVER (PARTITION BY product_number
           ORDER BY year_authorization, purchase_amount_eur, uniquevendorcode, purchase_quantity) AS n
  FROM purchases) WHERE n = 1""",
    "items_in_scope": _with(ITEMS) + "SELECT * FROM item_scope",
    "order_build": _with(PURCHASES, SALES, STOP, ITEMS)
    + f"""SELECT s.* REPLACE (CAST(turnover_euro AS DOUBLE) AS turnover_euro, CAST(margin_euro AS DOUBLE) AS margin_euro,
    CAST(list_price_turnover_euro AS DOUBLE) AS list_price_turnover_euro, {_GROUP} AS brand_type),
  i.*, f.purchase_stop_ind, y.purchase_year_authorization, y.purchase_amount_eur, y.purchase_quantity, y.purchase_rows
FROM sales_m s
JOIN item_scope i ON i.item_number = s.product_number
LEFT JOIN stop_flags f ON f.product_number = i.item_number
LEFT JOIN (SELECT product_number, year_authorization AS purchase_year_authorization,
                  CAST(sum(purchase_amount_eur) AS DOUBLE) AS purchase_amount_eur,
                  sum(purchase_quantity) AS purchase_quantity, count(*) AS purchase_rows
           FROM purchases GROUP BY 1, 2) y ON y.product_number = i.item_number
WHERE s.order_number IS NOT NULL AND s.year_number > 1997 AND f.purchase_stop_ind = 'N'""",
    "brand_group": _with(SALES)
    + f"""SELECT {_GROUP} AS brand_type, count(*) AS rows FROM sales
WHERE order_number IS NOT NULL AND year_number > 1997 GROUP BY 1""",
    "sales_brand_groups": _with(SALES)
    + f"SELECT brand_type, {_GROUP} AS brand_group, count(*) AS rows FROM sales GROUP BY 1, 2",
    "purchases_by_year": _with(PURCHASES)
    + """SELECT product_number AS item_number, year_authorization AS purchase_year_authorization,
  CAST(sum(purchase_amount_eur) AS DOUBLE) AS purchase_amount_eur, sum(purchase_quantity) AS purchase_quantity,
  count(*) AS purchase_rows FROM purchases GROUP BY 1, 2""",
    "product_build": _with(VALUES)
    + f"""SELECT product_id, brick_id, {_PRODUCT_COLUMNS} FROM (
  SELECT 'ticGoldenItem-' || CAST(p_partkey AS VARCHAR) AS product_id,
         CASE WHEN p_type <> 'PROMO' THEN p_brand END AS brick_id FROM part) b
JOIN clean c ON c.id = b.product_id AND starts_with(c.id, 'ticGoldenItem')
WHERE attribute_id <> 'attThreadType' GROUP BY product_id, brick_id""",
    "product_build_min": _with(VALUES)
    + f"""SELECT id AS product_id, {_max_of('attItemNumber')} AS product_number, {_max_of('taMat_3')} AS material,
  {_max_of('taLen_4')} AS length, {_max_of('taThread_6')} AS thread_diameter
FROM clean WHERE starts_with(id, 'ticGoldenItem') GROUP BY id""",
    "safe_columns": """SELECT 'ticGoldenItem-' || CAST(p_partkey AS VARCHAR) AS product_id, p_name AS wholesale_name,
  CASE WHEN p_type <> 'PROMO' THEN p_brand END AS brick_id, CAST(NULL AS VARCHAR) AS classification_node_id FROM part""",
    "stacked_columns": """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_acctbal AS balance,
  c_mktsegment AS segment FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, s_acctbal, NULL FROM supplier""",
    "stage_string_keys": "SELECT * REPLACE (CAST(p_partkey AS VARCHAR) AS p_partkey) FROM part",
    "attr_clean": _with(VALUES) + "SELECT * FROM clean",
    "attr_key": _with(LOCAL) + "SELECT attribute_id, attr_key, count(*) AS rows FROM keyed GROUP BY 1, 2",
    "attr_listagg": _with(LOCAL)
    + """SELECT item_number, attr_key, string_agg(DISTINCT value, ' | ' ORDER BY value) AS value_list
FROM keyed GROUP BY 1, 2""",
    "attr_list_pages": _with(LOCAL)
    + """SELECT attr_key, value, page, string_agg(item_number, ' | ' ORDER BY item_number) AS value_list FROM (
  SELECT attr_key, value, item_number, (CAST(sum(length(item_number) + 3) OVER (PARTITION BY attr_key, value ORDER BY item_number) AS BIGINT)
                                        - length(item_number) - 3) // 500 AS page
  FROM (SELECT DISTINCT attr_key, value, item_number FROM keyed WHERE value IS NOT NULL)) GROUP BY ALL""",
    "attr_list_joined": _with(LOCAL)
    + """SELECT item_number, attr_key, string_agg(DISTINCT value, ' | ' ORDER BY value) AS value_list
FROM keyed WHERE value IS NOT NULL GROUP BY 1, 2""",
    "enrich": _with(PURCHASES, LOCAL, _enriched("ENG"))
    + f"""SELECT p.* REPLACE (CAST(p.purchase_amount_eur AS DOUBLE) AS purchase_amount_eur), a.* EXCLUDE (product_number)
FROM (SELECT DISTINCT * FROM purchases) p LEFT JOIN attrs a ON a.product_number = p.product_number""",
    "enrich_attributes": _with(LOCAL, _enriched("NLD")) + "SELECT * FROM attrs",
    "merge_columns": """SELECT p_partkey, CASE WHEN a <> b THEN a || ' | ' || b ELSE coalesce(a, b) END AS merged FROM (
  SELECT p_partkey, CASE WHEN p_size > 10 THEN p_type END AS a,
         CASE WHEN p_size < 20 THEN p_type WHEN p_size < 40 THEN p_brand END AS b FROM part)""",
    "expected_attrs": """SELECT l_orderkey AS row_id, CAST(l_partkey AS VARCHAR) AS product_id,
  'att' || CAST(l_linenumber AS VARCHAR) AS attribute_id, CASE WHEN p_type <> 'PROMO' THEN p_brand END AS brick_id,
  p_type AS classification_node_id
FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_type <> 'PROMO' AND EXISTS (SELECT 1 FROM lineitem l2 JOIN part p2 ON p2.p_partkey = l2.l_partkey
    WHERE l2.l_linenumber = lineitem.l_linenumber AND p2.p_brand = part.p_brand)
    AND l_linenumber * 3 <= CAST(substr(p_brand, 7) AS INTEGER))
  OR l_linenumber > length(p_type)""",
    "attributes_wide": _with(LOCAL)
    + "SELECT item_number, language_id, "
    + ", ".join(
        f"min(value) FILTER (attribute_id = '{a}') AS \"{a}\""
        for a in (
            "taHeadShape",
            "taMaterial_2",
            "taMaterial_40",
            "taOther",
            "taSurfaceThreatment_11",
            "taSurfaceTreatment_4",
            "taThreadType_",
        )
    )
    + " FROM local GROUP BY 1, 2",
    "candidate_ids": _with(DETAILS)
    + """SELECT prefix || product_number AS product_id FROM wanted,
  (SELECT unnest(['ticGoldenItem-', 'ticArticle-', 'ticItem-', '']) AS prefix)""",
    "detail_fetch": _with(DETAILS) + "SELECT * FROM details",
    "detail_fetch_sparse": _with(SPARSE_DETAILS) + "SELECT * FROM details",
    "detail_fetch_wide": _with(DETAILS, WIDE)
    + "SELECT w.* FROM wide w JOIN wanted USING (product_number) WHERE detail_value IS NOT NULL",
    "detail_discovery": _with(DETAILS)
    + """SELECT detail_name, count(*) AS rows FROM long
WHERE detail_name IN ('Unit', 'Material', 'Head shape', 'Length') GROUP BY 1""",
    "detail_pivot": _with(DETAILS)
    + "SELECT product_number, "
    + ", ".join(f"max(detail_value) FILTER (detail_name = '{n}') AS \"{n}\"" for n in _DETAIL_NAMES)
    + " FROM details GROUP BY 1",
    "detail_unpivot": _with(WIDE) + "SELECT * FROM wide WHERE detail_value IS NOT NULL",
    "year_norm": """SELECT l_orderkey, l_linenumber, year_text, CASE WHEN l_linenumber <= 4 THEN y END AS year FROM (
  SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS y,
    CASE l_linenumber WHEN 1 THEN CAST(year(l_shipdate) AS VARCHAR) WHEN 2 THEN year(l_shipdate) || '-05-01'
      WHEN 3 THEN year(l_shipdate) || '-5-1' WHEN 4 THEN year(l_shipdate) || 'xyz' WHEN 5 THEN 'abcd' END AS year_text
  FROM lineitem)""",
    "year_quantity": _with(PURCHASES, YEAR_ROWS) + "SELECT * FROM year_rows",
    "year_map": _with(PURCHASES, YEAR_ROWS) + f"SELECT product_number, {_YEAR_SUMS} FROM year_rows GROUP BY 1",
    "class_map": _with(PURCHASES, YEAR_ROWS)
    + "SELECT product_number, arg_min(class4, (year, class4)) AS class4 FROM year_rows GROUP BY 1",
    "year_pivot": _with(PURCHASES, YEAR_ROWS) + f"SELECT product_number, {_YEAR_SUMS} FROM year_rows GROUP BY 1",
    "year_split": _with(PURCHASES, TIERS, YEAR_ROWS, SEGMENTS, SPLIT) + YEAR_SPLIT_ROWS,
    "year_split_export": _with(PURCHASES, TIERS, YEAR_ROWS, SEGMENTS, SPLIT)
    + "SELECT s.*, s.class4 AS class4_slug, g.product_description, g.segmentation"
    + " FROM split s LEFT JOIN segments g USING (product_number)",
    "year_enriched": _with(PURCHASES, TIERS, YEAR_ROWS, SEGMENTS)
    + """SELECT y.product_number, y.class4, y.year, y.purchase_quantity, g.product_description, g.segmentation
FROM year_rows y LEFT JOIN segments g USING (product_number)""",
    "year_fill": _with(PURCHASES, TIERS, YEAR_ROWS, SEGMENTS)
    + """SELECT y.product_number, y.class4, y.year, y.purchase_quantity, g.product_description
FROM year_rows y LEFT JOIN segments g USING (product_number)""",
    "replaced_class_export": _with(PURCHASES, YEAR_ROWS, SPLIT)
    + "SELECT *, class4 AS class4_slug FROM split WHERE class4 <> 'Brand#3' OR length(product_number) % 2 = 0",
    "csv_round_trip": "SELECT * FROM nation",
    "table_round_trip": """SELECT s_suppkey, s_name, 2 * count(*) OVER () AS rows, 2 AS columns FROM supplier
UNION ALL SELECT s_suppkey, s_name, 2 * count(*) OVER (), 2 FROM supplier""",
    "merge_exports": _with(PURCHASES, YEAR_ROWS, SPLIT, SPEND)
    + """SELECT *, 'split' AS source_export FROM split
UNION ALL BY NAME
SELECT class4, product_number, product_description, CAST(purchase_amount_eur AS DOUBLE) AS purchase_amount_eur,
       'spend' AS source_export FROM spend""",
    "year_metrics": _with(SALES) + f"SELECT product_number, {_metric_columns()} FROM sales_m GROUP BY 1",
    "year_totals": _with(SALES, PRODUCT_YEARS)
    + """SELECT product_number, CAST(sum(turnover) AS DOUBLE) AS turnover_eur_total, sum(quantity) AS quantity_sold_total,
  CAST(sum(orders) AS BIGINT) AS orders_total FROM product_years GROUP BY 1""",
    "super_summary": _with(SALES, PRODUCT_YEARS)
    + """SELECT count(DISTINCT product_number) AS rows, CAST(sum(turnover) AS DOUBLE) AS turnover_eur_total,
  CAST(sum(margin) AS DOUBLE) AS margin_gross_eur_total, CAST(sum(orders) AS BIGINT) AS orders_total FROM product_years""",
    "null_profile": _with(PURCHASES)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM purchases" for c in _PURCHASE_COLUMNS
    ),
    "describe": _DESCRIBE,
    "describe_blocks": _DESCRIBE,
    "histogram": _histogram("l_extendedprice"),
    "quantity_histogram": _histogram("l_quantity"),
    "top_vendors": _with(PURCHASES)
    + """SELECT crm_main_vendor, CAST(sum(purchase_amount_eur) AS DOUBLE) AS purchase_amount_eur
FROM purchases GROUP BY 1 ORDER BY sum(purchases.purchase_amount_eur) DESC, 1 LIMIT 15""",
    "spend_by_product": _with(SPEND)
    + """SELECT product_number, CAST(sum(purchase_amount_eur) AS DOUBLE) AS purchase_amount_eur
FROM spend GROUP BY 1""",
    "top_spend": _with(SPEND)
    + f"SELECT * REPLACE ({_EUR}) FROM spend ORDER BY spend.purchase_amount_eur DESC, product_number LIMIT 15",
    "class_counts": _with(PURCHASES) + "SELECT class2, count(*) AS rows FROM purchases GROUP BY 1",
    "spend_trend": _with(PURCHASES)
    + """SELECT crm_main_group_vendor, country_of_origin, year_authorization AS year,
  CAST(sum(purchase_amount_eur) AS DOUBLE) AS purchase_amount_eur FROM purchases GROUP BY 1, 2, 3""",
    "class_country_matrix": _with(PURCHASES)
    + "SELECT class4, "
    + ", ".join(
        f"CAST(coalesce(sum(purchase_amount_eur) FILTER (country_of_origin = 'NATION_{i}'), 0) AS DOUBLE) AS NATION_{i}"
        for i in range(25)
    )
    + " FROM purchases GROUP BY 1",
    "standardize_columns": _with(PURCHASES)
    + "SELECT "
    + ", ".join(
        (f"CAST({c} AS DOUBLE)" if c == "purchase_amount_eur" else c) + f' AS "{_title(c)}"' for c in _PURCHASE_COLUMNS
    )
    + " FROM purchases",
    "harmonize_columns": """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS brand_name,
  p_name AS class3, p_type AS class4 FROM part""",
    "spend_column": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS total_spend FROM customer",
    "amount_text": r"""SELECT s_suppkey, s_acctbal, format('{:,.2f} EUR', s_acctbal) AS formatted, s_acctbal AS parsed,
  s_acctbal >= 0 AND regexp_full_match(format('{:,.2f} EUR', s_acctbal), '\d{1,3}(,\d{3})*(\.\d{2})? EUR') AS is_valid
FROM (SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer)""",
    "amount_validity": """SELECT l_quantity >= 25 AS is_valid, count(*) AS rows, sum(l_quantity * 100 - 2500) AS total
FROM lineitem GROUP BY 1""",
    "safe_slug": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text,
  '[\\/:*?"<>|]', '_', 'g'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '_', 'g'), '_+', '_', 'g'), '_') AS slug FROM documents""",
    "class_code": _with(PURCHASES)
    + r"""SELECT class2, nullif(regexp_extract(class2, '^\s*(\d+)', 1), '') AS class2_code, count(*) AS rows
FROM purchases GROUP BY 1, 2""",
}
