from pathlib import Path

from editlens.plans import table_queries as plans

SF = "/root/testdata/sf0.001"


def test_manifests_are_compressed_and_whole(spark):
    root = Path(plans._manifest_root(spark, SF).removeprefix("file:"))
    files = [f for f in root.rglob("part-*")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert plans.s01_manifest_scan(spark, SF).count() == plans.read(spark, SF).count()
