"""JSON template documents: parse (bad JSON -> NULL), and a store that keeps each under its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: template folder.
TEMPLATE_FOLDER = "label-management/templates"


def parse_json(text) -> Column:
    """JSON text -> VARIANT; malformed documents give NULL (not an error)."""
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text)


def safe_name(c: Column) -> Column:
    """Spaces to '_', lower case (customer codes and template names in keys)."""
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))


def template_key(customer_code, template_name, app_prefix: str) -> Column:
    """``{prefix}/label-management/templates/{customer}/{name}.json``."""
    col = (lambda c: F.col(c) if isinstance(c, str) else c)
    return F.concat(F.lit(f"{app_prefix}/{TEMPLATE_FOLDER}/"), safe_name(col(customer_code)),
                    F.lit("/"), safe_name(col(template_name)), F.lit(".json"))


def write_templates(df: DataFrame, path: str, customer_col: str = "customer_code",
                    body_col: str = "template") -> None:
    """Write template documents as JSON lines, one folder per (safe) customer code: an export
    without names; :func:`save_templates` keeps each document under its key."""
    out = df.select(safe_name(F.col(customer_col)).alias("customer"),
                    F.to_json(F.col(body_col)).alias("value"))
    out.write.mode("append").partitionBy("customer").text(path)


STORE = "customer string, name string, value string"


def save_templates(df: DataFrame, path: str, customer_col: str = "customer_code", name_col: str = "template_name",
                   body_col: str = "template", order_col: str | None = None) -> None:
    """Saves template documents, each under its key: ``<path>/customer=<code>/name=<name>``.

    A document that exists under a key is replaced (dynamic partition overwrite), all others
    stay; a repeated call changes nothing. Of several rows with one key the one with the
    largest ``order_col`` (or text) is saved. ``body_col`` is a struct, map or VARIANT; a
    NULL body, and rows without a customer or name, are left out.
    """
    body = F.to_json(F.col(body_col))
    order = F.struct(F.col(order_col), body) if order_col else body
    rows = df.select(safe_name(F.col(customer_col)).alias("customer"), safe_name(F.col(name_col)).alias("name"),
                     body.alias("value"), order.alias("_order"))
    rows = rows.where("length(customer) > 0 and length(name) > 0 and value is not null")
    last = rows.groupBy("customer", "name").agg(F.max_by("value", "_order").alias("value"))
    last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("customer", "name").text(path)


def load_templates(spark: SparkSession, path: str, app_prefix: str = "", keys: DataFrame | None = None) -> DataFrame:
    """(customer, name, key, document) of the stored templates, or of those in ``keys`` (customer, name).

    Names are compared as they are stored (safe form); the join reads the wanted folders only
    (partition pruning). ``document`` is a VARIANT, NULL where a file isn't valid JSON.
    """
    rows = spark.read.schema(STORE).text(path, wholetext=True)
    if keys is not None:
        wanted = keys.select(safe_name(F.col(keys.columns[0])).alias("customer"),
                             safe_name(F.col(keys.columns[1])).alias("name")).distinct()
        rows = rows.join(wanted, ["customer", "name"], "left_semi")
    return rows.select("customer", "name", template_key("customer", "name", app_prefix).alias("key"),
                       parse_json("value").alias("document"))


def list_templates(spark: SparkSession, path: str, app_prefix: str = "", customer: str | None = None) -> DataFrame:
    """(customer, name, key) of the stored templates, or of one customer's."""
    rows = spark.read.schema(STORE).text(path, wholetext=True).select("customer", "name")
    if customer is not None:
        rows = rows.where(F.col("customer") == safe_name(F.lit(customer)))
    return rows.distinct().select("customer", "name", template_key("customer", "name", app_prefix).alias("key"))
