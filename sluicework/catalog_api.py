"""The catalogue as a class: the calls that a front end makes, each a DataFrame over the stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, matching, quality, registry


class Catalog:
    """Tables ``programmes``, ``sites``, ``runs``, ``users`` and ``documents`` under a root; reads are lazy, writes put a
    new version of a table in place of the last, in one step."""

    def __init__(self, spark: SparkSession, root: str, as_of: Column) -> None:
        self.spark, self.root, self.as_of = spark, root.rstrip("/"), as_of

    def table(self, name: str) -> DataFrame:
        """The newest whole version of a table; a table that was never replaced lies under its own name."""
        return self.spark.read.parquet(self._folder(name))

    def _folder(self, name: str) -> str:
        fs, pointers = self._files(f"{self.root}/_versions/{name}")
        if not fs.exists(pointers):
            return f"{self.root}/{name}"
        newest = max((f.getPath().getName() for f in fs.listStatus(pointers)), default=None)
        return f"{self.root}/{name}" if newest is None else f"{self.root}/_data/{name}/{newest.split('-', 1)[1]}"

    def _files(self, path: str):
        """File system and path, of whatever store the root is in."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _replace(self, name: str, df: DataFrame, read: str | None = None) -> None:
        """Writes the whole new table into a folder of its own, then makes it the newest by one file of the next number.

        A reader has the version that it opened; a crash before the file is made leaves the old version, a later one the new.
        The file must be new: of two writers of one number the second fails, and what it wrote is never read. ``read``: the
        version that ``df`` was made from (by default the newest now)."""
        fs, pointers = self._files(f"{self.root}/_versions/{name}")
        last = max((f.getPath().getName() for f in fs.listStatus(pointers)), default="0") if fs.exists(pointers) else "0"
        number, folder = int((read or last).split("-", 1)[0]) + 1, uuid.uuid4().hex
        df.write.parquet(f"{self.root}/_data/{name}/{folder}")
        claim = self._files(f"{self.root}/_versions/{name}.{number:012d}.claim")[1]
        try:
            fs.create(claim, False).close()  # fails if the number is taken
        except Exception as taken:
            raise RuntimeError(f"table {name} was replaced by another writer") from taken
        fs.mkdirs(pointers)
        fs.create(self._files(f"{self.root}/_versions/{name}/{number:012d}-{folder}")[1], False).close()

    def programmes(self, approved: bool | None = None) -> DataFrame:
        rows = self.table("programmes")
        return rows if approved is None else rows.filter((F.col("approval_status") == "approved") == approved)

    def final_programmes(self) -> DataFrame:
        return catalog.published(self.table("programmes")).orderBy(F.desc_nulls_last("updated_at"), "program_id")

    def publish(self, changes: DataFrame, now: Column | None = None) -> None:
        """Row changes of ``programmes`` (``op, seq`` and the row) carried over to the table ``final``."""
        self._replace("final", catalog.published_changes(self.table("final"), changes, now=now))

    def view(self) -> DataFrame:
        return registry.catalogue_view(self.table("programmes"), self.as_of)

    def scored(self) -> DataFrame:
        return quality.catalogue_score(self.table("programmes"), self.as_of)

    def matches(self, profiles: DataFrame, k: int = 20) -> DataFrame:
        return matching.best_for_profiles(self.scored(), profiles, k)

    def approve(self, ids: DataFrame, status: str = "approved") -> None:
        patch = ids.select("program_id", F.lit(status).alias("approval_status"), F.lit(1).alias("seq"))
        self._replace("programmes", registry.patched(self.table("programmes"), patch, "program_id", "seq"))

    def sites(self) -> DataFrame:
        return self.table("sites").orderBy("display_name")

    def create_site(self, site: DataFrame) -> list[str]:
        """Adds a site unless a stored one has its key, name, domain or adapter; gives what is taken."""
        columns = ["display_name", "site_key", "primary_domain", "adapter_key"]
        taken = catalog.duplicates_of(site, self.table("sites"), columns).first()["taken"]
        if not taken:
            self._replace("sites", self.table("sites").unionByName(site, allowMissingColumns=True))
        return taken

    def update_site(self, patch: DataFrame) -> None:
        self._replace("sites", registry.patched(self.table("sites"), patch.withColumn("seq", F.lit(1)), "site_key", "seq"))

    def delete_site(self, keys: DataFrame) -> None:
        self._replace("sites", self.table("sites").join(keys.select("site_key"), "site_key", "left_anti"))

    def runs(self, limit: int = 25) -> DataFrame:
        return self.table("runs").orderBy(F.desc_nulls_last("completed_at"), "run_id").limit(limit)

    def of_user(self, name: str, user_id: str) -> DataFrame:
        return self.table(name).filter(F.col("user_id") == user_id)

    def providers(self) -> DataFrame:
        """Names of funders in the order of a reader: letters before case and accents."""
        return self.table("programmes").select("funder_name").distinct().orderBy(F.collate("funder_name", "UNICODE"), "funder_name")
