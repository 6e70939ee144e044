"""Payment-term list and due dates over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import terms as T
from ledgerline.operators.joins import active, dim
from ledgerline.sources.tables import Tables

# The fallback term list used when no active term exists.
DEFAULT_TERMS = [
    (1, "Net 30", 30, "Payment due in 30 days"),
    (2, "Net 60", 60, "Payment due in 60 days"),
    (3, "Net 90", 90, "Payment due in 90 days"),
    (4, "COD", 0, "Cash on delivery"),
]


def payment_terms_list(t: Tables) -> DataFrame:
    """Active terms: id, name, description (name when missing), days; ordered by
    days then name. Falls back to the four default terms when none is active."""
    terms = active(t.payment_terms).select(
        "id", "name", F.coalesce(F.col("description"), F.col("name")).alias("description"),
        T.term_days_simple("name").alias("days"))
    if terms.isEmpty():  # bounded: stops at the first row
        terms = t.spark.createDataFrame(DEFAULT_TERMS, "id long, name string, days int, "
                                                       "description string")
    return terms.select("id", "name", "description", "days").orderBy("days", "name")


def invoice_terms(t: Tables) -> DataFrame:
    """Per active invoice, its payment term's name, days and description (30 days and
    no name where the id is unknown), by a join on the term id."""
    terms = payment_terms_list(t).select(F.col("id").alias("payment_term_id"), F.col("name").alias("term_name"),
                                         "days", F.col("description").alias("term_description"))
    pi = active(t.purchase_invoices).select(F.col("id").alias("invoice_id"), "payment_term_id")
    return pi.join(terms, "payment_term_id", "left").select(
        "invoice_id", "payment_term_id", "term_name", F.coalesce("days", F.lit(30)).alias("days"), "term_description")


def term_rules(df: DataFrame, name_col: str = "name") -> DataFrame:
    """Adds category and both day counts for a term-name column."""
    n = F.col(name_col)
    return df.withColumns({"category": T.term_category(n),
                           "days_by_category": T.term_days_by_category(n),
                           "days_simple": T.term_days_simple(n)})


def invoice_due_dates(t: Tables) -> DataFrame:
    """For every active invoice: its term's category, computed due date,
    explanation, review flag and both day counts.

    Terms are parsed in the term table, once each; an invoice adds date
    arithmetic only. An unknown term id is parsed as a missing name."""
    pi = active(t.purchase_invoices).select(
        F.col("id").alias("invoice_id"), "invoiced_date", "payment_term_id")

    def parsed(name, description):
        return F.struct(T.due_rule(name, description).alias("due"),
                        T.term_days_by_category(name).alias("days_by_category"),
                        T.term_days_simple(name).alias("days_simple"))

    terms = dim(t.payment_terms).select(
        F.col("id").alias("payment_term_id"), F.col("name").alias("term_name"),
        parsed(F.col("name"), F.col("description")).alias("_known"))
    none = parsed(F.lit(None).cast("string"), F.lit(None).cast("string"))
    j = pi.join(terms, "payment_term_id", "left").withColumn("_t", F.coalesce("_known", none))
    return j.select(
        "invoice_id", "term_name", "invoiced_date", F.col("_t.due.category").alias("category"),
        T.due_on("_t.due.rule", "_t.due.days", "invoiced_date").alias("due_date"),
        F.col("_t.due.explanation").alias("explanation"),
        F.col("_t.due.needs_review").alias("needs_review"),
        F.col("_t.days_by_category").alias("days_by_category"),
        F.col("_t.days_simple").alias("days_simple"))
