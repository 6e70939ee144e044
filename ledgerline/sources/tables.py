"""Domain tables as DataFrames.

Every job takes a :class:`Tables` and reads only the columns it needs, so
Catalyst prunes columns and pushes filters down to the Parquet scans.
"""

from __future__ import annotations

import hashlib
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import checkpoint_root, write_packed, write_parts
from ledgerline.sources import standin

DOMAIN_TABLES = (
    "purchase_orders", "product_purchase_orders", "arrivals", "arrival_details",
    "purchase_invoices", "purchase_invoice_details", "purchase_invoice_payments",
    "companies", "products", "currencies", "payment_terms", "exchange_rates",
    "medias", "purchase_invoice_medias", "employees", "file_manifest", "object_listing",
)

#: Tables of keys and quantities that grow with the orders.
LONG_TABLES = ("ln", "purchase_orders", "product_purchase_orders", "arrivals", "arrival_details", "purchase_invoices",
               "purchase_invoice_details", "purchase_invoice_payments")

_VERSION = hashlib.sha1("\n".join(standin.STANDIN_SQL.values()).encode()).hexdigest()[:10]


def _code_version() -> str:
    """Hash of the library sources: derived inputs are rebuilt when the code changes."""
    h = hashlib.sha1()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for d, _, files in sorted(os.walk(root)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(d, f), "rb") as fh:
                    h.update(fh.read())
    return h.hexdigest()[:10]


class Tables:
    """A name -> DataFrame catalog of the accounts-payable tables."""

    def __init__(self, spark: SparkSession, frames: dict, store: str | None = None):
        """``frames`` maps a name to a DataFrame or to a Parquet path read on first use;
        ``store`` is a folder (in the shared checkpoint folder) for derived inputs."""
        self.spark = spark
        self._frames = dict(frames)
        self._store = store
        self._derived: set[str] = set()

    def derived(self, name: str, build) -> DataFrame:
        """An input table built from other tables by ``build(self)`` (in parts, if it is long), written once.

        Used for stand-in inputs that several parts of a job read (e.g. a
        table of user selections): writing it to the shared checkpoint folder
        lets each reader scan Parquet instead of re-running the derivation.
        """
        if name in self._frames:
            return self.table(name)
        if self._store is not None:
            path = os.path.join(self._store, "derived-" + _code_version(), name)
            if not _complete(self.spark, path):
                with build(self) as parts:
                    write_parts(parts, path)
            df = self.spark.read.parquet(path)
        else:
            checkpoint_root(self.spark)
            with build(self) as parts:
                df = reduce(DataFrame.unionByName, parts).checkpoint(eager=True)
        self._frames[name] = df
        self._derived.add(name)
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.__dict__.get("_frames", {}):
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        v = self._frames[name]
        if isinstance(v, str):
            v = self._frames[name] = self.spark.read.parquet(v)
        return v

    def with_table(self, name: str, df: DataFrame) -> "Tables":
        """A copy with one table replaced (e.g. a new snapshot after an update)."""
        frames = {k: v for k, v in self._frames.items() if k not in self._derived}
        frames[name] = df
        return Tables(self.spark, frames)  # no store: what was derived came from the old tables

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Tables":
        """Production layout: one Parquet table per domain table under ``root``."""
        return cls(spark, {n: os.path.join(root, n) for n in DOMAIN_TABLES})

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str,
                      materialize: bool | None = None) -> "Tables":
        """Stand-in tables mapped from the test tables in ``sf_dir``.

        With ``materialize`` (default on, env ``LEDGERLINE_MATERIALIZE=0`` turns
        it off) each stand-in table is written once to the shared checkpoint
        folder and read back as Parquet, as real tables would be.
        """
        if materialize is None:
            materialize = os.environ.get("LEDGERLINE_MATERIALIZE", "1") != "0"
        if "://" not in sf_dir:
            sf_dir = os.path.abspath(sf_dir)
        tag = hashlib.sha1("\n".join([sf_dir, *_input_files(spark, sf_dir)]).encode()).hexdigest()[:8]
        store = None
        if materialize:
            store = os.path.join(checkpoint_root(spark), "ledgerline-standin", _VERSION, tag)
            paths = {n: os.path.join(store, n) for n in standin.STANDIN_TABLES}
            if all(_complete(spark, p) for p in paths.values()):
                return cls(spark, paths, store)

        for raw in standin.RAW_TABLES:
            spark.read.parquet(os.path.join(sf_dir, f"{raw}.parquet")) \
                .createOrReplaceTempView(f"ll_{tag}_raw_{raw}")

        def resolve(n: str) -> str:
            return f"ll_{tag}_raw_{n}" if n in standin.RAW_TABLES else f"ll_{tag}_{n}"

        frames = {}
        for name in standin.STANDIN_TABLES:
            df = spark.sql(standin.render(name, resolve))
            if store is not None:
                path = os.path.join(store, name)
                if not _complete(spark, path):
                    write_packed(df, path, "overwrite", delta=name in LONG_TABLES)
                df = spark.read.parquet(path)
            df.createOrReplaceTempView(resolve(name))
            frames[name] = df
        return cls(spark, frames, store)


def _input_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names, sizes and times of the raw tables' files: changed inputs get a store of their own."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for raw in standin.RAW_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{raw}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            out += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(path)]
    return sorted(out)


def _complete(spark: SparkSession, path: str) -> bool:
    """True when a previous write of ``path`` finished (Hadoop ``_SUCCESS`` marker)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)
