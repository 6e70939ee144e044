"""Stand-in accounts-payable tables derived from the TPC-H-like test tables.

The test data has no invoicing tables, so each domain table is mapped from a
test table by plain column expressions. The mapping only produces rows in the
schema the jobs expect; it does none of the jobs' work (no worklist, no
totals, no checks). The jobs in :mod:`ledgerline.operators` make no use of
how these rows were made and run unchanged on real tables of the same schema
(:meth:`ledgerline.sources.tables.Tables.from_parquet`).

The SQL is written in the subset shared by Spark SQL and DuckDB, so the
DuckDB oracle (``oracle/``) sees exactly the same input rows. ``{name}``
placeholders stand for a raw test table or an earlier stand-in table.
"""

from __future__ import annotations

# Raw test tables each stand-in reads (for the Spark side's views).
RAW_TABLES = ("lineitem", "orders", "customer", "supplier", "part", "region",
              "nation", "events", "pages")

# Ordered: a table may only reference raw tables and earlier entries.
STANDIN_SQL: dict[str, str] = {}

STANDIN_SQL["ln"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_tax,
       l_returnflag, l_linestatus, l_shipdate,
       l_orderkey * 100 + row_number() OVER (
         PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS line_id
FROM {lineitem}"""

# One currency per nation; the first five codes are those that the exchange rates use. One nation
# has no code and one is deleted.
STANDIN_SQL["currencies"] = """
SELECT cast(1 + n_nationkey AS bigint) AS id,
       CASE n_nationkey WHEN 0 THEN 'USD' WHEN 1 THEN 'VND' WHEN 2 THEN 'EUR' WHEN 3 THEN 'SGD' WHEN 4 THEN 'JPY'
            WHEN 5 THEN NULL ELSE upper(substr(n_name, 1, 2)) || cast(n_nationkey AS string) END AS code,
       'Currency of ' || n_name AS name, CASE WHEN n_nationkey = 7 THEN 1 ELSE 0 END AS delete_flag
FROM {nation}"""

# One payment term per supplier, of every wording the rules know, with the supplier's own numbers.
STANDIN_SQL["payment_terms"] = """
SELECT cast(1 + s_suppkey AS bigint) AS id,
       CASE s_suppkey % 16
         WHEN 0 THEN 'NET ' || n || ' DAYS' WHEN 1 THEN 'AMS ' || n || ' DAYS BY TT' WHEN 2 THEN 'COD'
         WHEN 3 THEN '40% DP, 60% Net ' || n WHEN 4 THEN 'TT on the ' || d || 'th of every month'
         WHEN 5 THEN 'EOM ' || n WHEN 6 THEN 'TT AFTER SHIPMENT' WHEN 7 THEN 'Net ' || n || ' days by LC'
         WHEN 8 THEN 'NET ' || n WHEN 9 THEN 'FINANCIAL TERMS' WHEN 10 THEN 'MOA ' || n
         WHEN 11 THEN '20:50:30 Net ' || n WHEN 12 THEN 'AMS ' || n || ' DAYS' WHEN 13 THEN 'CASH IN ADVANCE'
         WHEN 14 THEN '30% IN ADVANCE, 70% NET ' || n || ' DAYS' ELSE 'NET DAYS' END AS name,
       CASE WHEN s_suppkey % 3 = 0 THEN 'Balance NET ' || n || ' DAYS, ' || s_name END AS description,
       CASE WHEN s_suppkey % 19 = 7 THEN 1 ELSE 0 END AS delete_flag
FROM (SELECT s_suppkey, s_name, cast(5 + 5 * (s_suppkey % 18) AS string) AS n,
             cast(4 + s_suppkey % 17 AS string) AS d FROM {supplier}) s"""

STANDIN_SQL["companies"] = """
SELECT cast(s_suppkey AS bigint) AS id, s_name AS english_name,
       'S' || lpad(cast(s_suppkey AS string), 5, '0') AS company_code,
       CASE WHEN s_suppkey % 5 = 0 THEN 'Internal' ELSE 'External' END AS company_type,
       CASE WHEN s_nationkey % 3 = 0 THEN 'Domestic' ELSE 'Overseas' END AS location_type
FROM {supplier}
UNION ALL
SELECT cast(1000000 + r_regionkey AS bigint), 'Entity ' || r_name,
       'B' || cast(1000000 + r_regionkey AS string), 'Internal', 'Domestic'
FROM {region}"""

STANDIN_SQL["products"] = """
SELECT p_partkey AS id, p_name AS name,
       'PT' || lpad(cast(p_partkey AS string), 6, '0') AS pt_code,
       p_brand AS brand, cast(p_size AS string) || ' PCS' AS package_size,
       'PCS' AS standard_uom, 'VP-' || cast(p_partkey AS string) AS vendor_product_code
FROM {part}"""

STANDIN_SQL["employees"] = """
SELECT 'k' || cast(c_custkey AS string) AS keycloak_id, c_name AS first_name,
       c_mktsegment AS last_name
FROM {customer}"""

STANDIN_SQL["purchase_orders"] = """
SELECT o.o_orderkey AS id,
       'PO' || lpad(cast(o.o_orderkey AS string), 8, '0') AS po_number,
       cast(1 + o.o_orderkey % 5 AS bigint) AS currency_id,
       CASE WHEN o.o_orderkey % 3 = 0 THEN cast(0 AS bigint) ELSE s.seller END AS seller_company_id,
       cast(1000000 + o.o_custkey % 5 AS bigint) AS buyer_company_id,
       cast(1 + o.o_orderkey % 23 AS bigint) AS payment_term_id,
       'user' || cast(o.o_custkey % 7 AS string) AS creator,
       o.o_orderpriority AS po_type,
       'EXT-' || cast(o.o_custkey AS string) AS external_ref_number,
       o.o_orderdate AS created_date,
       CASE WHEN o.o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS delete_flag
FROM {orders} o
JOIN (SELECT l_orderkey, min(l_suppkey) AS seller FROM {lineitem} GROUP BY l_orderkey) s
  ON s.l_orderkey = o.o_orderkey"""

STANDIN_SQL["product_purchase_orders"] = """
SELECT l.line_id AS id, l.l_orderkey AS purchase_order_id, l.l_partkey AS product_id,
       cast(l.l_quantity AS decimal(15,2)) AS purchase_quantity,
       cast(l.l_quantity * (1 + l.l_partkey % 3) AS decimal(15,2)) AS quantity,
       cast(p.p_retailprice AS decimal(15,2)) AS purchase_unit_cost,
       CASE l.l_linenumber % 3 WHEN 0 THEN 'PCS' WHEN 1 THEN 'BOX' ELSE 'CTN' END AS purchaseuom,
       cast(1 + l.l_partkey % 3 AS int) AS uom_conversion,
       CASE WHEN l.line_id % 11 = 0 THEN NULL ELSE cast(round(l.l_tax * 100) AS int) END AS vat_gst,
       CASE WHEN l.line_id % 89 = 0 THEN 1 ELSE 0 END AS delete_flag
FROM {ln} l JOIN {part} p ON p.p_partkey = l.l_partkey"""

# Every fourth PO line arrives in a second part too; lines of one order in fifty all arrive for its
# first PO line (a hot PO line).
STANDIN_SQL["arrival_details"] = """
SELECT line_id + part * 5000000000 AS id,
       l_orderkey * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS arrival_id,
       CASE WHEN l_orderkey % 50 = 0 THEN l_orderkey * 100 + 1 ELSE line_id END AS product_purchase_order_id,
       cast(l_quantity * CASE WHEN part = 1 THEN 0.25 WHEN line_id % 10 = 0 THEN 1.5
                              WHEN line_id % 10 < 4 THEN 0.5 ELSE 1.0 END AS decimal(15,2)) AS arrival_quantity,
       CASE WHEN line_id % 103 = 0 THEN 1 ELSE 0 END AS delete_flag
FROM (SELECT *, 0 AS part FROM {ln} UNION ALL SELECT *, 1 AS part FROM {ln} WHERE line_id % 4 = 1) x"""

STANDIN_SQL["arrivals"] = """
SELECT arrival_id AS id,
       'AN' || lpad(cast(arrival_id AS string), 9, '0') AS arrival_note_number,
       cast(max(l_shipdate) AS date) AS arrival_date,
       max(l_shipdate) AS created_date,
       CASE WHEN arrival_id % 101 = 0 THEN 1 ELSE 0 END AS delete_flag
FROM (SELECT l_orderkey * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
               AS arrival_id, l_shipdate
      FROM {ln}) x
GROUP BY arrival_id"""

# Besides its own invoice line, a PO line can have a legacy line (part 1, no arrival line) and a second
# line for the same arrival (part 2), partly on the invoice of another order.
STANDIN_SQL["purchase_invoice_details"] = """
SELECT id, purchase_invoice_id, purchase_order_id, product_purchase_order_id, arrival_detail_id,
       qty AS purchased_invoice_quantity, qty AS invoiced_quantity,
       cast(round(base * (100 + vat_gst) * 0.01, 2) AS decimal(15,2)) AS amount,
       cast(round(base, 2) AS decimal(15,2)) AS amount_exclude_vat,
       vat_gst, cast(1 AS decimal(18,6)) AS exchange_rate, delete_flag
FROM (
  SELECT l.line_id + l.part * 5000000000 AS id,
         CASE WHEN l.part > 0 AND l.line_id % 2 = 0 THEN l.l_orderkey - l.l_orderkey % 4 ELSE l.l_orderkey END
           AS purchase_invoice_id,
         l.l_orderkey AS purchase_order_id, l.line_id AS product_purchase_order_id,
         CASE WHEN l.line_id % 13 = 0 OR l.part = 1 THEN NULL ELSE l.line_id END AS arrival_detail_id,
         cast(l.l_quantity * share AS decimal(15,2)) AS qty,
         cast(l.l_quantity * share AS decimal(15,2)) * cast(p.p_retailprice AS decimal(15,2)) AS base,
         cast(round(l.l_tax * 100) AS int) AS vat_gst,
         CASE WHEN l.line_id % 107 = 0 THEN 1 ELSE 0 END AS delete_flag
  FROM (SELECT *, 0 AS part, CASE WHEN line_id % 17 = 0 THEN 1.5 WHEN line_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS share
        FROM {ln}
        UNION ALL SELECT *, 1 AS part, 0.125 AS share FROM {ln} WHERE line_id % 5 = 2
        UNION ALL SELECT *, 2 AS part, 0.25 AS share FROM {ln} WHERE line_id % 6 = 1) l
  JOIN {part} p ON p.p_partkey = l.l_partkey
  WHERE l.l_linestatus = 'F') x"""

STANDIN_SQL["purchase_invoices"] = """
SELECT o.o_orderkey AS id,
       CASE WHEN o.o_orderkey % 40 < 3 THEN 'V-INV-REISSUED-' || cast(o.o_orderkey - o.o_orderkey % 40 AS string)
            ELSE 'V-INV' || replace(cast(cast(o.o_orderdate AS date) AS string), '-', '') || '-'
                 || cast(o.o_orderkey AS string) END
         || CASE WHEN o.o_orderkey % 6 = 0 THEN '-A' ELSE '-P' END AS invoice_number,
       cast(o.o_orderdate AS date) AS invoiced_date,
       cast(o.o_orderdate AS date) + cast(30 + 15 * (o.o_orderkey % 4) AS int) AS due_date,
       cast(CASE WHEN o.o_orderkey % 2 = 0 THEN floor(o.o_totalprice / 10000) * 10000
                 ELSE o.o_totalprice END AS decimal(15,2)) AS total_invoiced_amount,
       cast(round(cast(o.o_totalprice AS decimal(15,2)) * 0.9, 2) AS decimal(15,2))
         AS total_invoiced_amount_exclude_vat,
       po.seller_company_id AS seller_id, po.buyer_company_id AS buyer_id,
       CASE WHEN o.o_orderkey % 3 = 0 THEN cast(1 AS bigint) ELSE po.currency_id END AS currency_id,
       po.payment_term_id,
       'k' || cast(o.o_custkey AS string) AS created_by,
       CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE 'CI-' || cast(o.o_orderkey AS string) END
         AS commercial_invoice_no,
       cast(NULL AS decimal(18,6)) AS usd_exchange_rate,
       CASE WHEN o.o_orderkey % 6 = 0 THEN 'Advance Payment' ELSE 'Commercial Invoice' END
         AS invoice_type,
       cast(o.o_orderkey % 2 AS int) AS email_to_accountant,
       CASE WHEN o.o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS advance_payment,
       o.o_orderdate AS created_date,
       CASE WHEN o.o_orderkey < 0 THEN o.o_orderdate END AS modified_date,
       CASE WHEN o.o_orderkey % 59 = 0 THEN 1 ELSE 0 END AS delete_flag
FROM {orders} o JOIN {purchase_orders} po ON po.id = o.o_orderkey
WHERE o.o_orderkey IN (SELECT purchase_invoice_id FROM {purchase_invoice_details})"""

STANDIN_SQL["purchase_invoice_payments"] = """
SELECT pi.id + x.part * 5000000000 AS id, pi.id AS purchase_invoice_id,
       CASE WHEN x.o_orderstatus = 'F' AND x.parts = 1 THEN pi.total_invoiced_amount
            ELSE cast(round(pi.total_invoiced_amount * 0.5, 2) AS decimal(15,2)) END AS amount,
       pi.invoiced_date + cast(10 + x.o_orderkey % 20 + x.part AS int) AS payment_date,
       CASE WHEN x.o_orderkey % 71 = 0 THEN 1 ELSE 0 END AS delete_flag
FROM {purchase_invoices} pi
JOIN (SELECT o_orderkey, o_orderstatus, 0 AS part, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS parts
      FROM {orders}
      UNION ALL SELECT o_orderkey, o_orderstatus, 1 AS part, 2 AS parts FROM {orders}
      WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'F') x ON x.o_orderkey = pi.id
WHERE x.o_orderstatus IN ('F', 'P')"""

STANDIN_SQL["exchange_rates"] = """
SELECT e.event_id AS id, cf.code AS from_currency_code, ct.code AS to_currency_code,
       CASE WHEN e.event_id % 41 = 0 THEN NULL ELSE cast(e.value AS decimal(18,6)) END AS rate_value,
       cast(e.ts AS date) AS rate_date, e.ts AS created_date,
       CASE WHEN e.event_id % 37 = 0 THEN 1 ELSE 0 END AS delete_flag
FROM (SELECT event_id, value, ts, user_id, user_id % 5 AS f, event_id % 5 AS t
      FROM {events} WHERE event_type = 'purchase') e
JOIN {currencies} cf ON cf.id = e.f + 1
JOIN {currencies} ct ON ct.id = e.t + 1
WHERE e.f <> e.t AND NOT (e.f = 3 AND e.t = 4) AND NOT (e.f = 4 AND e.t = 3)
  AND NOT (e.f > e.t AND (e.user_id + e.event_id) % 5 IN (1, 3))"""

STANDIN_SQL["medias"] = """
SELECT id, name, 'purchase-invoice-file/' || cast(1700000000000 + id * 1000 AS string) || '_' || name
         AS path,
       'k' || cast(id AS string) AS created_by, created_date, created_date AS updated_date,
       0 AS version
FROM (SELECT p.page_id AS id,
             'inv_' || cast(p.page_id AS string)
               || CASE p.page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '.jpg' END AS name,
             o.o_orderdate AS created_date
      FROM {pages} p LEFT JOIN {orders} o ON o.o_orderkey = p.page_id
      WHERE p.page_id % 4 <> 0) m"""

STANDIN_SQL["purchase_invoice_medias"] = """
SELECT page_id AS id, page_id * 37 AS purchase_invoice_id, page_id AS media_id,
       'k' || cast(page_id % 50 AS string) AS created_by,
       o.o_orderdate AS created_date, CASE WHEN page_id < 0 THEN o.o_orderdate END AS modified_date,
       CASE WHEN page_id % 9 = 0 THEN 1 ELSE 0 END AS delete_flag, 0 AS version
FROM {pages} p LEFT JOIN {orders} o ON o.o_orderkey = p.page_id
WHERE page_id % 4 <> 0"""

STANDIN_SQL["file_manifest"] = """
SELECT CASE WHEN page_id < 12 THEN cast(0 AS bigint)
            ELSE 1 + cast(floor(page_id / 8) AS bigint) END AS batch_id,
       cast(CASE WHEN page_id < 12 THEN page_id + 1 ELSE page_id % 8 + 1 END AS int) AS idx,
       CASE page_id % 8 WHEN 0 THEN 'scan 1.pdf' WHEN 1 THEN 'scan 1.pdf'
            WHEN 2 THEN 'hóa đơn.PDF' WHEN 3 THEN 'inv.exe' WHEN 4 THEN 'noext'
            WHEN 5 THEN 'photo_' || cast(page_id AS string) || '.PNG'
            WHEN 6 THEN 'inv-' || cast(page_id AS string) || '.jpg'
            ELSE repeat('a', 120) || '.jpeg' END AS filename,
       cast(length(html) AS bigint) * 1000 AS size
FROM {pages}"""

STANDIN_SQL["object_listing"] = """
SELECT CASE page_id % 10
         WHEN 0 THEN 'purchase-invoice-file/archive' || cast(page_id AS string) || '/'
         WHEN 1 THEN 'purchase-invoice-file/archive' || cast(page_id - 1 AS string) || '/.keep'
         WHEN 2 THEN 'app/label-management/templates/cust' || cast(page_id % 7 AS string)
                     || '/tpl_' || cast(page_id AS string) || '.json'
         ELSE 'purchase-invoice-file/' || cast(1700000000000 + page_id * 1000 AS string) || '_inv_'
              || cast(page_id AS string)
              || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '.jpg' END
       END AS key,
       CASE WHEN page_id % 10 IN (0, 1) THEN cast(0 AS bigint)
            ELSE cast(length(html) AS bigint) * 100 END AS size,
       o.o_orderdate AS last_modified, md5(html) AS etag
FROM {pages} p LEFT JOIN {orders} o ON o.o_orderkey = p.page_id"""

# Stand-in names in dependency order.
STANDIN_TABLES = tuple(STANDIN_SQL)


def render(name: str, resolve) -> str:
    """SQL text of one stand-in table, each ``{x}`` replaced by ``resolve(x)``."""
    names = set(RAW_TABLES) | set(STANDIN_TABLES)
    return STANDIN_SQL[name].format(**{n: resolve(n) for n in names})
