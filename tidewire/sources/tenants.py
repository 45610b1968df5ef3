"""Tables of many tenants: partitioned by tenant, and read for one tenant at a time.

There is no way to read such a table without naming the tenant: the filter is part of every read, so files of others are
not even listed among those to scan, and a row of another tenant is as absent as one that does not exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

TENANT = "tenant_id"
#: The folders' column; its values are marked, so that Spark never takes tenants for numbers, of which 1 and 01 would be one.
FOLDER, MARK = "_tenant", "t-"


def store_tenants(rows: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Writes rows, each of which must have a tenant, to the table's folders of their tenants."""
    if TENANT not in rows.columns:
        raise ValueError(f"rows need {TENANT}")
    tenant = F.col(TENANT).cast("string")
    folder = F.when(tenant.isNull(), F.raise_error(F.lit("a row without a tenant")).cast("string")).otherwise(F.concat(F.lit(MARK), tenant))
    # a large tenant is written by several tasks
    part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(8))
    rows.withColumn(FOLDER, folder).repartition(F.col(FOLDER), part).write.mode(mode).partitionBy(FOLDER).parquet(f"{root}/{table}")


class TenantTables:
    """One tenant's view of the tables in ``root``."""

    def __init__(self, spark: SparkSession, root: str, tenant: str):
        if not tenant or not str(tenant).strip():
            raise PermissionError("no tenant")
        self.spark, self.root, self.tenant = spark, root.rstrip("/"), str(tenant)

    def read(self, table: str) -> DataFrame:
        """The tenant's rows."""
        return self.spark.read.parquet(f"{self.root}/{table}").where(F.col(FOLDER) == MARK + self.tenant).drop(FOLDER)

    def get(self, table: str, key: str, value: object) -> Row:
        """One row by its key; LookupError if the tenant has none."""
        found = self.read(table).where(F.col(key) == F.lit(value)).limit(1).collect()
        if not found:
            raise LookupError(f"no {table} {value}")
        return found[0]

    def listed(self, table: str, where: Column | None = None, order: Sequence[Column | str] = (), limit: int | None = None) -> DataFrame:
        """The tenant's rows that meet a condition, in order, the first so many."""
        rows = self.read(table)
        rows = rows if where is None else rows.where(where)
        rows = rows.orderBy(*order) if order else rows
        return rows if limit is None else rows.limit(limit)

    def joined(self, table: str, other: str, keys: Sequence[str], how: str = "inner") -> DataFrame:
        """Two of the tenant's tables joined: both sides are the tenant's own."""
        return self.read(table).join(self.read(other).drop(TENANT), list(keys), how)

    def nested(self, parent: str, children: str, key: str, child_columns: Sequence[str], name: str) -> DataFrame:
        """The tenant's parents, each with the array of its children in the order of their columns; parents without any have an empty one."""
        kids = self.read(children).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*child_columns))).alias(name))
        rows = self.read(parent).join(kids, key, "left")
        return rows.withColumn(name, F.coalesce(name, F.array().cast(kids.schema[name].dataType)))

    def cuttings(self, status: str | None = None, edition: object = None) -> DataFrame:
        """Cuttings (cutting_id, page_id, status, created_at, ...), newest first; of one status or one edition, by the pages (page_id, edition_id) it has."""
        rows = self._of("cuttings", "status", status)
        if edition is not None:
            rows = rows.join(self.read("pages").where(F.col("edition_id") == F.lit(edition)).select("page_id"), "page_id", "left_semi")
        return rows.orderBy(F.desc_nulls_last("created_at"), "cutting_id")

    def logo_templates(self, active_only: bool = False) -> DataFrame:
        rows = self.read("logo_templates")
        return (rows.where("is_active") if active_only else rows).orderBy(F.desc_nulls_last("created_at"), "template_id")

    def logo_matches(self, status: str | None = None) -> DataFrame:
        return self._of("logo_matches", "status", status).orderBy(F.desc_nulls_last("created_at"), "match_id")

    def social_matches(self, posts: DataFrame, accounts: DataFrame, status: str | None = None) -> DataFrame:
        """Social matches, newest first, each with its post and in that the post's account; both are no tenant's own. What is not there is null."""
        inner = posts.join(accounts.select("account_id", F.struct(*accounts.columns).alias("account")), "account_id", "left")
        post = inner.select("post_id", F.struct(*posts.columns, "account").alias("post"))
        return self._of("social_matches", "status", status).join(post, "post_id", "left").orderBy(F.desc_nulls_last("created_at"), "match_id")

    def _of(self, table: str, column: str, value: object) -> DataFrame:
        rows = self.read(table)
        return rows if value is None else rows.where(F.col(column) == F.lit(value))
