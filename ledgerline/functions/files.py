"""File-name and file-size column expressions for invoice attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.money import col_

# Upload rules and storage layout.
ALLOWED_FILE_TYPES = ["pdf", "png", "jpg", "jpeg"]
MAX_FILE_SIZE_MB = 10
MAX_FILE_SIZE_BYTES = MAX_FILE_SIZE_MB * 1024 * 1024
MAX_FILES_COUNT = 10
INVOICE_FILE_PREFIX = "purchase-invoice-file/"
CONTENT_TYPES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
                 "jpeg": "image/jpeg"}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
FILE_ICONS = {"pdf": "📄", "png": "🖼️", "jpg": "🖼️", "jpeg": "🖼️"}
DEFAULT_ICON = "📎"
VALID_NAME_RE = r"(?U)^[a-zA-Z0-9\s_\-\.]+$"
UNSAFE_CHARS_RE = r"[^a-zA-Z0-9._\-]"


def file_extension(name) -> Column:
    """Lower-cased text after the last dot; '' when there is no dot."""
    n = col_(name)
    return F.when(n.contains("."), F.lower(F.substring_index(n, ".", -1))).otherwise(F.lit(""))


def _lookup(ext: Column, table: dict, default: str) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(ext == k, F.lit(v)) if out is None else out.when(ext == k, F.lit(v))
    return out.otherwise(F.lit(default))


def content_type(name) -> Column:
    return _lookup(file_extension(name), CONTENT_TYPES, DEFAULT_CONTENT_TYPE)


def file_icon(name) -> Column:
    return _lookup(file_extension(name), FILE_ICONS, DEFAULT_ICON)


def valid_filename(name) -> Column:
    """Only letters, digits, whitespace, '_', '-' and '.'."""
    return col_(name).rlike(VALID_NAME_RE)


def sanitize_filename(name) -> Column:
    """Spaces to '_', other unsafe characters dropped, lower case, and the part
    before the last dot cut to 100 characters."""
    s = F.lower(F.regexp_replace(F.replace(col_(name), F.lit(" "), F.lit("_")),
                                 UNSAFE_CHARS_RE, ""))
    stem = F.regexp_extract(s, r"^(.*)\.[^.]*$", 1)
    return F.when(s.contains("."),
                  F.concat(F.substring(stem, 1, 100), F.lit("."), F.substring_index(s, ".", -1))
                  ).otherwise(s)


def object_key(sanitized_name, timestamp_ms) -> Column:
    """``purchase-invoice-file/{ms}_{name}``."""
    return F.concat(F.lit(INVOICE_FILE_PREFIX), col_(timestamp_ms).cast("string"), F.lit("_"),
                    col_(sanitized_name))


def _one_decimal(c: Column) -> Column:
    return F.regexp_replace(F.format_number(c, 1), ",", "")


def file_size_text(size_bytes) -> Column:
    """'512 B', '1.2 KB', '5.0 MB'."""
    b = col_(size_bytes)
    return (F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
            .when(b < 1024 * 1024, F.concat(_one_decimal(b / 1024.0), F.lit(" KB")))
            .otherwise(F.concat(_one_decimal(b / (1024.0 * 1024.0)), F.lit(" MB"))))


def last_segment(key) -> Column:
    """Text after the last '/' of an object key."""
    return F.substring_index(col_(key), "/", -1)


def full_name(first, last) -> Column:
    """CONCAT(first, ' ', last): NULL when either part is NULL."""
    return F.concat(col_(first), F.lit(" "), col_(last))
