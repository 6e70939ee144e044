"""DuckDB oracle SQL: stand-in tables as CTEs plus independently written SQL.

The oracle re-states each job in plain SQL over the same stand-in rows (the
stand-in mapping text is shared with the Spark side, see
``ledgerline/sources/standin.py``); the job logic itself is written here
separately, in SQL, and never imported from the Spark code.
"""

from __future__ import annotations

from ledgerline.sources import standin

AS_OF = "DATE '2001-07-31'"


def _standin_ctes() -> list[str]:
    return [f"{name} AS ({standin.render(name, lambda n: n)})" for name in standin.STANDIN_TABLES]


# Views, re-stated in SQL (the formulas documented in ledgerline/plans/views.py).
VIEW_CTES = [
    """det AS (
  SELECT d.* FROM purchase_invoice_details d
  JOIN purchase_invoices pi ON pi.id = d.purchase_invoice_id
  WHERE d.delete_flag = 0 AND pi.delete_flag = 0)""",
    """arr_lines AS (
  SELECT ad.id AS can_line_id, ad.arrival_id, ad.product_purchase_order_id, ad.arrival_quantity,
         a.arrival_note_number, a.arrival_date, a.created_date
  FROM arrival_details ad JOIN arrivals a ON a.id = ad.arrival_id
  WHERE ad.delete_flag = 0 AND a.delete_flag = 0)""",
    """inv_by_line AS (
  SELECT arrival_detail_id, sum(purchased_invoice_quantity) AS q
  FROM det WHERE arrival_detail_id IS NOT NULL GROUP BY arrival_detail_id)""",
    """inv_by_po_line AS (
  SELECT product_purchase_order_id, sum(purchased_invoice_quantity) AS q
  FROM det GROUP BY product_purchase_order_id)""",
    """legacy_by_po_line AS (
  SELECT product_purchase_order_id, sum(purchased_invoice_quantity) AS legacy_qty,
         count(DISTINCT purchase_invoice_id) AS legacy_count
  FROM det WHERE arrival_detail_id IS NULL GROUP BY product_purchase_order_id)""",
    """arr_by_po_line AS (
  SELECT product_purchase_order_id, sum(arrival_quantity) AS q
  FROM arr_lines GROUP BY product_purchase_order_id)""",
    f"""can0 AS (
  SELECT l.can_line_id, l.arrival_note_number, l.arrival_date, po.creator,
         cast(datediff('day', l.arrival_date, {AS_OF}) AS int) AS days_since_arrival,
         l.created_date, s.english_name AS vendor, s.company_code AS vendor_code,
         s.company_type AS vendor_type, s.location_type AS vendor_location_type,
         b.english_name AS consignee, b.company_code AS consignee_code,
         po.po_number, po.po_type, po.external_ref_number, pt.name AS payment_term,
         ppo.id AS product_purchase_order_id, p.name AS product_name, p.pt_code, p.brand,
         p.package_size, p.standard_uom, ppo.purchaseuom AS buying_uom, ppo.uom_conversion,
         l.arrival_quantity, coalesce(il.q, 0) AS invoiced, ppo.purchase_quantity AS pq,
         coalesce(ip.q, 0) AS po_invoiced, coalesce(ap.q, 0) AS arrived,
         ppo.purchase_unit_cost, c.code AS currency_code
  FROM arr_lines l
  JOIN product_purchase_orders ppo ON ppo.id = l.product_purchase_order_id
  JOIN purchase_orders po ON po.id = ppo.purchase_order_id AND po.delete_flag = 0
  JOIN products p ON p.id = ppo.product_id
  JOIN companies s ON s.id = po.seller_company_id
  JOIN companies b ON b.id = po.buyer_company_id
  JOIN currencies c ON c.id = po.currency_id
  LEFT JOIN payment_terms pt ON pt.id = po.payment_term_id
  LEFT JOIN inv_by_line il ON il.arrival_detail_id = l.can_line_id
  LEFT JOIN inv_by_po_line ip ON ip.product_purchase_order_id = ppo.id
  LEFT JOIN arr_by_po_line ap ON ap.product_purchase_order_id = ppo.id)""",
    """can_tracking_full_view AS (
  SELECT can_line_id, arrival_note_number, arrival_date, creator, days_since_arrival,
         created_date, vendor, vendor_code, vendor_type, vendor_location_type,
         consignee, consignee_code, po_number, po_type, external_ref_number, payment_term,
         product_purchase_order_id, product_name, pt_code, brand, package_size, standard_uom,
         buying_uom, uom_conversion,
         cast(arrival_quantity AS decimal(18,2)) AS arrival_quantity,
         cast(greatest(0, arrival_quantity - invoiced) AS decimal(18,2)) AS uninvoiced_quantity,
         cast(invoiced AS decimal(18,2)) AS total_invoiced_quantity,
         CASE WHEN invoiced = 0 THEN 'Not Invoiced'
              WHEN arrival_quantity - invoiced > 0 THEN 'Partially Invoiced'
              ELSE 'Fully Invoiced' END AS invoice_status,
         cast(round(purchase_unit_cost, 2) AS decimal(15,2)) || ' ' || currency_code
           AS buying_unit_cost,
         cast(round(purchase_unit_cost / uom_conversion, 4) AS decimal(18,4)) AS standard_unit_cost,
         cast(round(cast(round(purchase_unit_cost / uom_conversion, 4) AS decimal(18,4)) * 1.05, 4)
              AS decimal(18,4)) AS landed_cost,
         CASE WHEN currency_code = 'USD' THEN
           cast(round(cast(round(purchase_unit_cost / uom_conversion, 4) AS decimal(18,4)) * 1.05, 4)
                AS decimal(18,4)) END AS landed_cost_usd,
         CASE WHEN pq - po_invoiced <= 0 THEN 'Fully Invoiced'
              WHEN arrived >= pq THEN 'Fully Arrived'
              WHEN arrived > 0 THEN 'Partially Arrived' ELSE 'Pending' END AS po_line_status,
         CASE WHEN arrived > pq THEN 'Y' ELSE 'N' END AS po_line_is_over_delivered,
         CASE WHEN pq - po_invoiced < 0 THEN 'Y' ELSE 'N' END AS po_line_is_over_invoiced,
         cast(CASE WHEN pq <> 0 THEN round(arrived * 100 / pq, 2) END AS decimal(24,2))
           AS po_line_arrival_completion_percent,
         cast(CASE WHEN pq <> 0 THEN round(po_invoiced * 100 / pq, 2) END AS decimal(24,2))
           AS po_line_invoice_completion_percent,
         cast(pq - po_invoiced AS decimal(18,2)) AS po_line_pending_invoiced_qty
  FROM can0)""",
    """pay AS (
  SELECT purchase_invoice_id, sum(amount) AS paid, count(*) AS n, max(payment_date) AS last_date
  FROM purchase_invoice_payments WHERE delete_flag = 0 GROUP BY purchase_invoice_id)""",
    f"""hdr0 AS (
  SELECT pi.id AS pi_id, pi.invoice_number AS inv_number,
         pi.commercial_invoice_no AS commercial_inv_number, pi.invoiced_date AS inv_date,
         pi.due_date, cast(pi.total_invoiced_amount AS decimal(15,2)) AS total_invoiced_amount,
         s.english_name AS vendor, s.company_code AS vendor_code,
         b.english_name AS legal_entity, b.company_code AS legal_entity_code,
         c.code AS invoiced_currency, pt.name AS payment_term, pi.created_by,
         pi.invoice_type AS inv_type, pi.advance_payment AS is_advance_payment,
         pi.email_to_accountant, coalesce(pay.paid, 0) AS paid,
         coalesce(pay.n, 0) AS payment_count, pay.last_date AS last_payment_date
  FROM purchase_invoices pi
  JOIN companies s ON s.id = pi.seller_id
  JOIN companies b ON b.id = pi.buyer_id
  JOIN currencies c ON c.id = pi.currency_id
  LEFT JOIN payment_terms pt ON pt.id = pi.payment_term_id
  LEFT JOIN pay ON pay.purchase_invoice_id = pi.id
  WHERE pi.delete_flag = 0)""",
    f"""hdr1 AS (
  SELECT *, CASE WHEN paid >= total_invoiced_amount THEN 'Fully Paid'
                 WHEN paid > 0 THEN 'Partially Paid' ELSE 'Unpaid' END AS payment_status
  FROM hdr0)""",
    f"""hdr AS (
  SELECT pi_id, inv_number, commercial_inv_number, inv_date, due_date, total_invoiced_amount,
         vendor, vendor_code, legal_entity, legal_entity_code, invoiced_currency, payment_term,
         created_by, inv_type, is_advance_payment, email_to_accountant,
         cast(paid AS decimal(24,2)) AS total_payment_made, payment_count, last_payment_date,
         cast(CASE WHEN total_invoiced_amount > 0 THEN round(paid / total_invoiced_amount, 4)
                   ELSE 0 END AS decimal(24,4)) AS payment_ratio,
         payment_status,
         cast(total_invoiced_amount - paid AS decimal(24,2)) AS total_outstanding_amount,
         cast(CASE WHEN payment_status <> 'Fully Paid'
                   THEN greatest(0, datediff('day', due_date, {AS_OF})) ELSE 0 END AS int)
           AS days_overdue
  FROM hdr1)""",
    """hdr_aged AS (
  SELECT *, CASE WHEN payment_status = 'Fully Paid' THEN 'Paid' WHEN days_overdue = 0 THEN 'Current'
                 WHEN days_overdue <= 30 THEN '1-30 Days' WHEN days_overdue <= 60 THEN '31-60 Days'
                 WHEN days_overdue <= 90 THEN '61-90 Days' ELSE 'Over 90 Days' END AS aging_status,
            CASE WHEN payment_status = 'Fully Paid' THEN 'None' WHEN days_overdue > 90 THEN 'High'
                 WHEN days_overdue > 30 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM hdr)""",
    """inv_lines AS (
  SELECT d.purchase_invoice_id AS pi_id, d.id AS pi_line_id, po.po_number, p.pt_code,
         p.name AS product_name, p.vendor_product_code, p.brand,
         cast(d.invoiced_quantity AS decimal(18,2)) AS invoiced_quantity,
         ppo.purchaseuom AS buying_uom,
         cast(round(ppo.purchase_unit_cost * d.exchange_rate, 2) AS decimal(24,2)) AS inv_unit_price,
         cast(d.amount AS decimal(15,2)) AS invoiced_amount, d.vat_gst AS vat_percent,
         al.arrival_note_number AS can_number, al.arrival_date,
         ppo.purchase_quantity AS orig,
         CASE WHEN ppo.delete_flag = 1 THEN ppo.purchase_quantity ELSE 0 END AS cancelled,
         coalesce(ip.q, 0) AS po_invoiced
  FROM det d
  JOIN product_purchase_orders ppo ON ppo.id = d.product_purchase_order_id
  JOIN purchase_orders po ON po.id = d.purchase_order_id
  JOIN products p ON p.id = ppo.product_id
  LEFT JOIN arr_lines al ON al.can_line_id = d.arrival_detail_id
  LEFT JOIN inv_by_po_line ip ON ip.product_purchase_order_id = ppo.id)""",
    """purchase_invoice_full_view AS (
  SELECT l.pi_line_id, l.po_number, l.pt_code, l.product_name, l.vendor_product_code, l.brand,
         l.invoiced_quantity, l.buying_uom, l.inv_unit_price, l.invoiced_amount, l.vat_percent,
         l.can_number, l.arrival_date,
         cast(l.orig AS decimal(18,2)) AS po_original_buying_quantity,
         cast(l.cancelled AS decimal(18,2)) AS po_cancelled_buying_quantity,
         cast(l.orig - l.cancelled AS decimal(18,2)) AS buying_ordered_quantity,
         cast(l.orig - l.cancelled - l.po_invoiced AS decimal(18,2)) AS remaining_buying_qty_to_invoice,
         cast(CASE WHEN l.orig - l.cancelled <> 0
                   THEN round(l.po_invoiced * 100 / (l.orig - l.cancelled), 2) END AS decimal(24,2))
           AS invoice_completion_percent,
         CASE WHEN l.orig - l.cancelled - l.po_invoiced <= 0 THEN 'Fully Invoiced'
              ELSE 'Partially Invoiced' END AS invoice_status,
         CASE WHEN l.cancelled = 0 THEN 'Not Cancelled' ELSE 'Cancelled' END AS po_cancellation_status,
         CASE WHEN l.orig - l.cancelled - l.po_invoiced < 0 THEN 'Y' ELSE 'N' END AS is_over_invoiced,
         h.*
  FROM inv_lines l JOIN hdr_aged h ON h.pi_id = l.pi_id)""",
]


def with_ctes(body: str, extra: list[str] | None = None) -> str:
    """``WITH <stand-ins>, <views>, <extra> <body>``."""
    ctes = _standin_ctes() + VIEW_CTES + list(extra or [])
    if body.lstrip().startswith("WITH "):  # a body with CTEs of its own
        body = f"SELECT * FROM ({body})"
    return "WITH " + ",\n".join(ctes) + "\n" + body
