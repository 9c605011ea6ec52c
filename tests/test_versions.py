"""Tables that change as a whole or not at all, and keyed copies that rewrite only what changed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opsignal.plans import build
from opsignal.schemas import TRIGGERED
from opsignal.sources import tables, versions


def half_way(df, last):
    """Rows written in order, of which the last one fails the job after others have been written."""
    broken = F.when(F.col("id") == last, F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
    return df.coalesce(1).withColumn("id", broken.cast("long"))


def test_a_write_that_fails_half_way_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(5), path)
    reader = versions.read_table(spark, path)
    with pytest.raises(Exception, match="lost"):
        tables.write_table(half_way(spark.range(200_000), 199_999), path)
    assert versions.read_table(spark, path).count() == 5 and versions.version_of(spark, path).number == 1
    # written as a whole, but lost before the commit
    versions.prepared(spark.range(7), path)
    assert versions.read_table(spark, path).count() == 5
    tables.write_table(spark.range(9), path)
    assert versions.read_table(spark, path).count() == 9
    assert reader.count() == 5
    assert versions.read_table(spark, path, 1).count() == 5
    # the two failed writes and, as only one version is kept, the first one
    assert versions.expire(spark, path, keep=1) in (2, 3)
    assert versions.read_table(spark, path).count() == 9 and versions.version_of(spark, path, 1) is None


def test_no_table_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, str(tmp_path / "none"))
    versions.prepared(spark.range(3), str(tmp_path / "t"))
    assert versions.version_of(spark, str(tmp_path / "t")) is None


def test_two_writers_of_one_version_are_noticed(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(1), path)
    spark.createDataFrame([("{}",)], "value string").write.mode("append").text(f"{path}/versions/000000000001")
    with pytest.raises(RuntimeError, match="two writers"):
        versions.read_table(spark, path)


def test_partitions_and_empty_tables(spark, tmp_path):
    rows = spark.sql("SELECT id, date_add(DATE'2024-01-01', cast(id % 3 AS int)) AS day FROM range(30)")
    table = tables.write_table(rows, str(tmp_path / "p"), None, "day")
    assert sorted(map(tuple, table.select("id", "day").collect())) == sorted(map(tuple, rows.collect()))
    assert dict(table.dtypes)["day"] == "date"
    empty = tables.write_table(rows.limit(0), str(tmp_path / "e"), None)
    assert empty.count() == 0 and empty.columns == ["id", "day"]


def keyed(spark, n, **changed):
    rows = spark.range(n).select(F.col("id"), F.concat(F.lit("v"), "id").alias("v"))
    for i, v in changed.items():
        rows = rows.withColumn("v", F.when(F.col("id") == int(i[1:]), F.lit(v)).otherwise(F.col("v")))
    return rows


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "copy")
    tables.sync_copy(spark, keyed(spark, 1000), path, ["id"], TRIGGERED, parts=16)
    first = versions.version_of(spark, path)
    done = tables.sync_copy(spark, keyed(spark, 1000, _7="new", _8=None).where("id <> 9"), path, ["id"], TRIGGERED, parts=16)
    assert {r.op: r.n for r in done.collect()} == {"update": 2, "delete": 1}
    second = versions.version_of(spark, path)
    moved = [p for p in first.folders if first.folders[p] != second.folders[p]]
    assert len(first.folders) == 16 and 1 <= len(moved) <= 3
    assert {r.id: r.v for r in versions.read_table(spark, path).where("id BETWEEN 6 AND 10").collect()} == {6: "v6", 7: "new", 8: None, 10: "v10"}
    # nothing changed: no version
    same = keyed(spark, 1000, _7="new", _8=None).where("id <> 9")
    assert tables.sync_copy(spark, same.repartition(5), path, ["id"], TRIGGERED, parts=16).collect() == []
    assert versions.version_of(spark, path).number == 2
    # other parts, other columns, or no rows at all
    tables.sync_copy(spark, same, path, ["id"], TRIGGERED, parts=4)
    assert len(versions.version_of(spark, path).folders) == 4 and versions.read_table(spark, path).count() == 999
    tables.sync_copy(spark, same.withColumn("w", F.lit(1)), path, ["id"], TRIGGERED, parts=4)
    assert versions.read_table(spark, path).columns == ["id", "v", "w"]
    done = tables.sync_copy(spark, same.withColumn("w", F.lit(1)).limit(0), path, ["id"], TRIGGERED, parts=4)
    assert {r.op: r.n for r in done.collect()} == {"delete": 999}
    assert versions.read_table(spark, path).count() == 0 and versions.version_of(spark, path).folders == {}


def test_repeated_keys_are_refused_before_anything_is_written(spark, tmp_path):
    path = str(tmp_path / "copy")
    tables.sync_copy(spark, keyed(spark, 10), path, ["id"], TRIGGERED)
    with pytest.raises(ValueError, match=r"more than once, among them \[\(3,\)\]"):
        tables.sync_copy(spark, keyed(spark, 10).unionByName(keyed(spark, 4).where("id = 3")), path, ["id"], TRIGGERED)
    assert versions.version_of(spark, path).number == 1


def test_the_source_of_a_copy_is_read_once(spark, tmp_path):
    """A source that differs from run to run: what is compared is what is written."""
    path = str(tmp_path / "copy")
    drawn = spark.range(300).withColumn("v", F.rand())
    tables.sync_copy(spark, drawn, path, ["id"], TRIGGERED)
    done = {r.op: r.n for r in tables.sync_copy(spark, drawn, path, ["id"], TRIGGERED).collect()}
    assert set(done) <= {"update"} and versions.read_table(spark, path).count() == 300
    version = versions.version_of(spark, path)
    assert sum(n for n, _, _ in version.digests.values()) == 300


def test_a_build_that_fails_leaves_the_old_one(spark, inputs, tmp_path, monkeypatch):
    config = {"config_service_profiles": spark.sql("SELECT 'a' AS service_name, 'd' AS domain, 't' AS tier, 'b' AS business_unit, array('c') AS depends_on")}
    from opsignal import fixtures as fx

    bronze = {n: df.limit(40) for n, df in fx.bronze(spark, inputs.sf_dir).items()}
    built = build.build_all(spark, bronze | config, str(tmp_path))
    assert "gold_dependency_blast_radius" in built and "silver_revenue_impact" not in built
    assert [tuple(r)[:2] for r in built["gold_dependency_blast_radius"].collect()] == [("c", 1)]
    before = {n: versions.version_of(spark, f"{tmp_path}/{n}").number for n in built}
    monkeypatch.setitem(build.GOLD, "gold_business_impact_summary", (lambda t: half_way(t.withColumn("id", F.lit(1)), 1), ("silver_incidents",)))
    with pytest.raises(Exception, match="lost"):
        build.build_all(spark, {n: df.limit(3) for n, df in bronze.items()}, str(tmp_path))
    assert {n: versions.version_of(spark, f"{tmp_path}/{n}").number for n in built} == before
    assert versions.read_table(spark, f"{tmp_path}/bronze_alerts").count() == 40


def test_columns_that_rows_share_are_written_once_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.sql("SELECT id, if(id = 5, NULL, concat('k', id % 3)) AS key, id * 2 AS twice FROM range(6)")
    lists = spark.sql("SELECT * FROM VALUES ('k0', array('a', 'b')), ('k1', array('c')) AS t(key, list)")
    for _ in range(2):
        versions.prepared(spark.range(3), path)  # a write that was never committed
        made = versions.with_shared(versions.prepared(rows, path), lists, "key", ["id", "key", "list", "twice"])
        versions.commit(spark, made)
    versions.expire(spark, path, keep=1)
    want = [(0, "k0", ["a", "b"], 0), (1, "k1", ["c"], 2), (2, "k2", None, 4), (3, "k0", ["a", "b"], 6), (4, "k1", ["c"], 8), (5, None, None, 10)]
    read = versions.read_table(spark, path)
    assert read.columns == ["id", "key", "list", "twice"] and sorted(map(tuple, read.collect())) == want
    narrow = versions.version_of(spark, path).read(spark, schema=read.select("twice", "id").schema)
    assert sorted(map(tuple, narrow.collect())) == [(w[3], w[0]) for w in want]
    assert sorted(p.name for p in (tmp_path / "t" / "data").iterdir()) == sorted(f.split("/")[1] for f in (made.folders[""], made.shared["folder"]))


def test_a_build_writes_the_services_of_a_pattern_once(spark, inputs, tmp_path):
    """As part of every row they took the square of the services; what is read is the same."""
    from opsignal import fixtures as fx
    from opsignal.plans import gold

    bronze = {n: df.limit(400) for n, df in fx.bronze(spark, inputs.sf_dir).items()}
    bronze["bronze_incidents"] = spark.createDataFrame(inputs.incidents.collect(), inputs.incidents.schema)
    got = build.build_all(spark, bronze, str(tmp_path))["gold_root_cause_patterns"]
    want = gold.root_cause_patterns(inputs.scored)
    assert got.columns == [*want.columns, "computed_at"] and got.drop("computed_at").schema.simpleString() == want.schema.simpleString()
    again = versions.read_table(spark, f"{tmp_path}/gold_root_cause_patterns")
    assert sorted(map(str, got.drop("computed_at").collect())) == sorted(map(str, want.collect())) and sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    written = [spark.read.parquet(str(p)) for p in (tmp_path / "gold_root_cause_patterns" / "data").iterdir()]
    lists = [df for df in written if "all_impacted_services" in df.columns]
    assert sum(df.count() for df in lists) == want.where("all_impacted_services IS NOT NULL").select("failure_pattern_id").distinct().count() < want.count()


@pytest.mark.parametrize("name", ["p1_build_configured", "p1_written_tables"])
def test_queries_that_build_write_the_services_of_a_pattern_once(spark, inputs, tmp_path, monkeypatch, name):
    from opsignal import catalog

    monkeypatch.setattr(catalog, "new_folder", lambda spark, label: str(tmp_path))
    catalog.QUERIES[name](spark, inputs.sf_dir)
    written = [spark.read.parquet(str(p)) for p in (tmp_path / "gold_root_cause_patterns" / "data").iterdir()]
    lists = sum(df.count() for df in written if "all_impacted_services" in df.columns)
    table = versions.read_table(spark, f"{tmp_path}/gold_root_cause_patterns")
    assert lists == table.where("all_impacted_services IS NOT NULL").select("failure_pattern_id").distinct().count() < table.count()
