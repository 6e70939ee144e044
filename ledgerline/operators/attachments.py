"""Invoice attachments: upload-manifest checks, prepared keys, media rows,
attachment look-ups and object-store listings (as tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import files as FL
from ledgerline.functions.money import size_mb
from ledgerline.operators.appends import append_batch
from ledgerline.operators.joins import active, dim
from ledgerline.operators.sequence import row_numbers
from ledgerline.session import written
from ledgerline.sources.tables import Tables

ALLOWED_TEXT = ", ".join(FL.ALLOWED_FILE_TYPES)

# Messages of the upload checks.
MSG_TYPE = ("Invalid type '.", f"' (allowed: {ALLOWED_TEXT})")
MSG_SIZE = ("File too large (", f" MB > {FL.MAX_FILE_SIZE_MB} MB limit)")
MSG_DUPLICATE = "Duplicate filename in upload"
MSG_NAME = "Invalid filename (contains special characters)"
MSG_FILE = ("File #", " (", "): ")
MSG_TOO_MANY = "❌ Too many files. Maximum %d files allowed (you selected %d)"
MSG_TOTAL = ("❌ Total size too large (", " MB)")


def manifest_check(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate upload batches (batch_id, idx, filename, size).

    Returns ``(files, batches)``. A batch of more than ten files is rejected
    as a whole and has no file rows. Otherwise each file is checked for type,
    size (10 MB), a repeated name earlier in the batch, and unsafe characters;
    all errors of a file are listed. ``batches`` gives the verdict per batch.
    Batch sizes and first uses of a name are aggregates joined back (no
    per-batch window).
    """
    counts = manifest.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_files"))
    firsts = manifest.groupBy("batch_id", "filename").agg(F.min("idx").alias("_first_idx"))
    f = (manifest.join(counts, "batch_id")
         .where(F.col("n_files") <= FL.MAX_FILES_COUNT)
         .join(firsts, ["batch_id", "filename"]))
    ext = FL.file_extension(F.col("filename"))
    errs = F.filter(F.array(
        F.when(~ext.isin(FL.ALLOWED_FILE_TYPES),
               F.concat(F.lit(MSG_TYPE[0]), ext, F.lit(MSG_TYPE[1]))),
        F.when(F.col("size") > FL.MAX_FILE_SIZE_BYTES,
               F.concat(F.lit(MSG_SIZE[0]),
                        F.regexp_replace(F.format_number(F.col("size") / 1024.0 / 1024.0, 1),
                                         ",", ""),
                        F.lit(MSG_SIZE[1]))),
        F.when(F.col("idx") > F.col("_first_idx"), F.lit(MSG_DUPLICATE)),
        F.when(~FL.valid_filename(F.col("filename")),
               F.lit(MSG_NAME))),
        lambda e: e.isNotNull())
    files = f.select(
        "batch_id", "idx", "filename", "size", ext.alias("extension"),
        (F.size(errs) == 0).alias("is_ok"),
        F.when(F.size(errs) > 0, F.concat(F.lit(MSG_FILE[0]), F.col("idx").cast("string"),
                                          F.lit(MSG_FILE[1]), F.col("filename"), F.lit(MSG_FILE[2]),
                                          F.array_join(errs, ", "))).alias("error"),
        size_mb(F.col("size")).alias("size_mb"), F.upper(ext).alias("type"))
    per_batch = files.groupBy("batch_id").agg(
        F.count_if(~F.col("is_ok")).alias("n_errors"),
        F.sum(F.when(F.col("is_ok"), F.col("size")).otherwise(F.lit(0))).alias("valid_bytes"))
    too_big = F.col("valid_bytes") / 1024.0 / 1024.0 > FL.MAX_FILE_SIZE_MB * FL.MAX_FILES_COUNT
    batches = counts.join(per_batch, "batch_id", "left").select(
        "batch_id", "n_files",
        F.when(F.col("n_files") > FL.MAX_FILES_COUNT,
               F.format_string(MSG_TOO_MANY, F.lit(FL.MAX_FILES_COUNT), F.col("n_files")))
        .when(too_big, F.concat(F.lit(MSG_TOTAL[0]),
                                F.format_number(F.col("valid_bytes") / 1024.0 / 1024.0, 1),
                                F.lit(MSG_TOTAL[1]))).alias("batch_error"),
        F.coalesce(F.col("n_errors"), F.lit(0)).alias("n_file_errors"))
    batches = batches.withColumn(
        "is_valid", F.col("batch_error").isNull() & (F.col("n_file_errors") == 0))
    return files, batches


def file_summary(files: DataFrame) -> DataFrame:
    """Per batch, over the files that passed: count, bytes, size text, types."""
    ok = files.where("is_ok")
    return ok.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("count"), F.sum("size").alias("total_size"),
        FL.file_size_text(F.sum("size")).alias("total_size_formatted"),
        F.array_sort(F.collect_set("type")).alias("types"))


def prepare_files(manifest: DataFrame, base_ms: DataFrame) -> DataFrame:
    """Storage key, sanitised name, size and content type per file.

    ``base_ms``: (batch_id, base_ms) upload time of each batch; file ``idx``
    (1-based) gets timestamp ``base_ms + idx - 1``, so keys are unique.
    """
    m = manifest.join(base_ms, "batch_id")
    clean = FL.sanitize_filename(F.col("filename"))
    ts = F.col("base_ms") + F.col("idx") - 1
    return m.select("batch_id", "idx", F.col("filename").alias("original_name"),
                    clean.alias("sanitized_name"), FL.object_key(clean, ts).alias("s3_key"),
                    "size", FL.content_type(F.col("filename")).alias("content_type"))


def new_media_rows(t: Tables, keys: DataFrame, created_by: str, created_at) -> DataFrame:
    """Media rows for stored keys: id after the current maximum (gap-free, in
    key order), name = last path segment, version 0."""
    max_id = t.medias.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one scalar
    numbered = row_numbers(keys.select("s3_key").distinct(), [], ["s3_key"], out="_n")
    ts = F.lit(created_at).cast("timestamp")
    return numbered.select(
        (F.lit(max_id) + F.col("_n")).cast("long").alias("id"),
        FL.last_segment(F.col("s3_key")).alias("name"), F.col("s3_key").alias("path"),
        F.lit(created_by).alias("created_by"), ts.alias("created_date"),
        ts.alias("updated_date"), F.lit(0).alias("version"))


def append_media(media: DataFrame, root: str, batch: str | None = None) -> dict[str, int]:
    """Append rows of :func:`new_media_rows` to the media table under ``root``."""
    return append_batch(root, {"medias": media}, batch)


def invoice_attachments(t: Tables, invoice_ids: DataFrame | None = None) -> DataFrame:
    """Active attachment links with media and uploader name, newest first."""
    links = active(t.purchase_invoice_medias).select(
        "purchase_invoice_id", F.col("id").alias("link_id"), "media_id")
    if invoice_ids is not None:
        links = links.join(invoice_ids.select(F.col(invoice_ids.columns[0])
                                              .alias("purchase_invoice_id")),
                           "purchase_invoice_id", "left_semi")
    media = t.medias.select(F.col("id").alias("media_id"), F.col("name").alias("filename"),
                            F.col("path").alias("s3_key"), "created_by", "created_date")
    emp = dim(t.employees.select(F.col("keycloak_id").alias("created_by"),
                                 FL.full_name(F.col("first_name"), F.col("last_name"))
                                 .alias("uploaded_by")))
    return (links.join(media, "media_id").join(emp, "created_by", "left")
            .select("purchase_invoice_id", "media_id", "filename", "s3_key", "created_by",
                    "created_date", "link_id", "uploaded_by")
            .orderBy(F.col("created_date").desc()))


# ---------------------------------------------------------------------------
# object listings (a table of key, size, last_modified, etag)
# ---------------------------------------------------------------------------

def _prefix(prefix: str) -> str:
    return prefix if not prefix or prefix.endswith("/") else prefix + "/"


def list_files(listing: DataFrame, prefix: str = "", max_keys: int | None = None) -> DataFrame:
    """Files under ``prefix``, without folder markers and ``.keep`` files.
    ``max_keys`` takes only the first keys in key order, as one listing page does."""
    p = _prefix(prefix)
    page = listing.where(F.col("key").startswith(p))
    if max_keys is not None:
        page = page.orderBy("key").limit(max_keys)
    return page.where(~F.col("key").endswith("/") & ~F.col("key").endswith(".keep")).select(
        "key", FL.last_segment(F.col("key")).alias("name"), "size",
        size_mb(F.col("size")).alias("size_mb"), "last_modified", "etag")


def list_folders(listing: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct next path segment under ``prefix`` of keys that go deeper."""
    p = _prefix(prefix)
    rest = F.substring(F.col("key"), len(p) + 1, 1 << 30)
    return (listing.where(F.col("key").startswith(p) & rest.contains("/"))
            .select(F.substring_index(rest, "/", 1).alias("folder")).distinct().orderBy("folder"))


def folder_sizes(listing: DataFrame, depth: int = 1) -> DataFrame:
    """Bytes, MB, GB and object count per folder (the first ``depth`` path
    segments; objects higher up belong to the folders above them, '' being the
    root); ``.keep`` files are skipped, folder markers are not."""
    parts = F.split(F.col("key"), "/")
    above = F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1))
    folder = F.when(F.size(above) > 0, F.concat(F.array_join(above, "/"), F.lit("/"))).otherwise("")
    f = listing.where(~F.col("key").endswith(".keep"))
    return (f.groupBy(folder.alias("prefix"))
            .agg(F.sum("size").alias("total_bytes"), F.count(F.lit(1)).alias("file_count"))
            .select("prefix", "total_bytes",
                    F.round(F.col("total_bytes") / 1024.0 / 1024.0, 2).alias("total_mb"),
                    F.round(F.col("total_bytes") / 1024.0 / 1024.0 / 1024.0, 2).alias("total_gb"),
                    "file_count"))


def invoice_file_keys(listing: DataFrame) -> DataFrame:
    """Keys split into invoice files (under the invoice prefix) and the rest."""
    inv = F.col("key").startswith(FL.INVOICE_FILE_PREFIX)
    return listing.agg(F.count_if(inv).alias("invoice_keys"),
                       F.count_if(~inv).alias("filtered_out"))


def orphan_objects(t: Tables) -> DataFrame:
    """Invoice files in storage that no media row points to (report only)."""
    files = list_files(t.object_listing, FL.INVOICE_FILE_PREFIX, max_keys=None)
    return files.join(t.medias.select(F.col("path").alias("key")), "key", "left_anti")


LISTING = "key string, size long, last_modified timestamp, etag string, is_folder boolean"


def list_store(spark: SparkSession, root: str, parts: int | None = None) -> DataFrame:
    """The listing table of a store, made by tasks: (key, size, last_modified, etag).

    One level of folders is listed at a time: the folders of a level are dealt over tasks, each
    lists its own, files become rows, folders are the next level. No process sees the whole
    listing; the driver only learns whether a level has folders. Levels are written, so a lost
    executor repeats its folders of one level. ``root`` is a path or a URI that Arrow's file
    systems open on the executors (a shared file system, s3://, gs://, hdfs://); a
    store that only Spark reads is listed by :func:`listing_from_folder`.
    """
    def entries(batches):
        import pyarrow as pa
        from pyarrow import fs

        types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.bool_()]
        names = ["key", "size", "last_modified", "etag", "is_folder"]
        store, top = (fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:")
                      else (fs.LocalFileSystem(), root))
        top = top.rstrip("/")
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{top}/{prefix}" if prefix else top))
                for at in range(0, len(found), 10_000):
                    rows = [(f.path[len(top) + 1:], f.size or 0, f.mtime, None, f.type == fs.FileType.Directory)
                            for f in found[at:at + 10_000]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    level, files = spark.createDataFrame([("",)], "prefix string"), None
    tasks = parts or spark.sparkContext.defaultParallelism
    while True:
        found = written(level.repartition(tasks, "prefix").mapInArrow(entries, LISTING), "listing")
        mine = found.where(~F.col("is_folder")).drop("is_folder")
        files = mine if files is None else files.unionByName(mine)
        level = found.where("is_folder").select(F.col("key").alias("prefix"))
        if level.isEmpty():
            return files


def listing_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What happened between two listings: (key, change, old_size, new_size) with change
    ``added``, ``removed`` or ``changed`` (another size, time or etag)."""
    side = lambda df, name: df.select(
        "key", F.struct("size", "last_modified", "etag").alias(name))
    j = side(old, "o").join(side(new, "n"), "key", "full_outer")
    change = (F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed")
              .when(~F.col("o").eqNullSafe(F.col("n")), "changed"))
    return j.select("key", change.alias("change"), F.col("o.size").alias("old_size"),
                    F.col("n.size").alias("new_size")).where(F.col("change").isNotNull())


def listing_from_folder(spark, root: str) -> DataFrame:
    """Listing table of a real folder through the ``binaryFile`` source, keys
    relative to ``root`` (content is not read: only path, length and time)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(path).toString().rstrip("/") + "/"
    return df.select(F.substring(F.col("path"), len(base) + 1, 1 << 30).alias("key"), F.col("length").alias("size"),
                     F.col("modificationTime").alias("last_modified"),
                     F.lit(None).cast("string").alias("etag"))
