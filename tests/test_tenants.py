"""No read goes beyond its tenant, and files of others are not scanned."""

import pytest
from pyspark.sql import functions as F

from tidewire.sources.tenants import TenantTables, store_tenants


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tenants"))
    rows = spark.createDataFrame([("1", 1, "draft"), ("1", 2, "sent"), ("2", 1, "sent"), ("2", 3, "draft"), ("01", 8, "sent")], "tenant_id string, report_id long, status string")
    items = spark.createDataFrame([("1", 1, 5), ("1", 1, 4), ("2", 1, 9), ("2", 3, 7)], "tenant_id string, report_id long, item long")
    store_tenants(rows, root, "reports")
    store_tenants(items, root, "items")
    return root


def test_only_own_rows(spark, root):
    one, two = TenantTables(spark, root, "1"), TenantTables(spark, root, "2")
    assert sorted(r.report_id for r in one.read("reports").collect()) == [1, 2]
    assert [r.report_id for r in two.listed("reports", F.col("status") == "sent", ["report_id"], 5).collect()] == [1]
    assert one.get("reports", "report_id", 1).status == "draft" and two.get("reports", "report_id", 1).status == "sent"
    with pytest.raises(LookupError):
        one.get("reports", "report_id", 3)
    assert sorted((r.report_id, r.item) for r in one.joined("reports", "items", ["report_id"]).collect()) == [(1, 4), (1, 5)]
    nested = {r.report_id: [x.item for x in r["items"]] for r in one.nested("reports", "items", "report_id", ["item"], "items").collect()}
    assert nested == {1: [4, 5], 2: []}


def test_files_of_others_are_not_scanned(spark, root):
    plan = TenantTables(spark, root, "1").read("reports")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_tenant" in plan
    assert {f.split("_tenant=t-")[1].split("/")[0] for f in TenantTables(spark, root, "1").read("reports").select("_metadata.file_path").distinct().toPandas().file_path} == {"1"}


def test_no_tenant_no_rows(spark, root):
    for nobody in ("", " ", None):
        with pytest.raises(PermissionError):
            TenantTables(spark, root, nobody)
    assert TenantTables(spark, root, "3").read("reports").count() == 0
    with pytest.raises(Exception, match="without a tenant"):
        store_tenants(spark.createDataFrame([(None, 1)], "tenant_id string, report_id long"), root, "bad")
    with pytest.raises(ValueError):
        store_tenants(spark.range(1), root, "bad")
