"""Sources, sinks, versioned indexes and the watched folder."""

from __future__ import annotations

import duckdb
import pytest
from compare import rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

from rankweave.operators import incremental
from rankweave.plans import source_queries
from rankweave.sources import io
from rankweave.streaming import watch


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1.0", "Ann", "Python (Expert)", None, None, "x, y", "dev", 3.5), ("nan", "Bob", None, None, None, None, None, None), (" 7 ", None, None, None, None, None, None, None)], io.PROFILE)
    io.write_csv(rows, str(tmp_path / "p"))
    found = {r["id"]: r for r in io.read_csv(spark, str(tmp_path / "p")).collect()}
    assert set(found) == {"1", "7"} and found["1"]["skill_summary"] == "x, y" and found["1"]["years_of_experience"] == 3.5


def test_json_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a"], {"k": 1.5})], "id int, l array<string>, m map<string,double>")
    io.write_json(rows, str(tmp_path / "j"))
    assert io.read_json(spark, str(tmp_path / "j"), rows.schema).collect() == rows.collect()


def test_reference_lists(spark, tmp_path):
    path = tmp_path / "list.md"
    path.write_text("# Top\n## Cloud (12 skills)\n### Deeper\n* Python (core)\n*  SQL\n* R\nplain\n## Data\n* Python (core)\n")
    assert {r[0] for r in io.reference_list(spark, str(path)).collect()} == {"Python (core)", "SQL", "R"}
    assert {r[0] for r in io.reference_headings(spark, str(path)).collect()} == {"Cloud", "Data"}
    assert {r[0] for r in io.reference_skills(spark, str(path)).collect()} == {"Python", "SQL"}
    known = io.canonical_lists({"skill": io.reference_skills(spark, str(path))})
    assert {tuple(r) for r in known.collect()} == {("skill", "python", "Python"), ("skill", "sql", "SQL")}
    io.append_new(spark.createDataFrame([("Go",), ("PYTHON",), ("go ",)], "name string"), known, str(tmp_path / "new"))
    assert [r[0].lower() for r in spark.read.text(str(tmp_path / "new")).collect()] == ["* go"]


def test_index_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        io.load_index(spark, path)
    one = spark.createDataFrame([(1, "a")], "id long, t string")
    assert io.save_index({"r": one}, path) == 1
    assert io.save_index({"r": io.load_index(spark, path)["r"].unionByName(one)}, path) == 2
    found = io.load_index(spark, path, {"missing": "x int"})
    assert found["r"].count() == 2 and found["missing"].count() == 0
    assert io.read_or_empty(spark, path + "/none", "x int").count() == 0


def test_snapshots(spark, tmp_path):
    state, seen = str(tmp_path / "state"), []
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    apply = lambda changes, df: seen.append((sorted(map(tuple, changes.collect())), sorted(map(tuple, df.collect()))))
    watch.sync_snapshot(spark, rows((1, "a"), (2, "b")), "id", ["v"], state, apply)
    watch.sync_snapshot(spark, rows((2, "c"), (3, "d")), "id", ["v"], state, apply)
    watch.sync_snapshot(spark, rows((2, "c"), (3, "d")), "id", ["v"], state, apply)
    assert seen[0] == ([("1", "new"), ("2", "new")], [(1, "a"), (2, "b")])
    assert seen[1] == ([("1", "deleted"), ("2", "changed"), ("3", "new")], [(2, "c"), (3, "d")])
    assert seen[2] == ([("2", "unchanged"), ("3", "unchanged")], [])


def test_stream(spark, tmp_path):
    source, state, check = (str(tmp_path / x) for x in ("in", "state", "check"))
    seen = []

    def apply(changes, df):
        seen.append((sorted(map(tuple, changes.collect())), sorted(map(tuple, df.collect()))))

    for batch in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c"), (1, "z")]):
        spark.createDataFrame(batch, "id long, v string").coalesce(1).write.mode("append").parquet(source)
        watch.upsert_stream(spark, source, "id long, v string", "id", ["v"], state, check, apply).awaitTermination()
    assert seen == [([("1", "new"), ("2", "new")], [(1, "a"), (2, "b")]), ([("1", "changed"), ("2", "unchanged"), ("3", "new")], [(1, "z"), (3, "c")])]


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 3)
    one, two = (incremental.fingerprint(d, ["id", "v"]).first() for d in (df, df.orderBy(F.desc("id")).repartition(3)))
    assert one == two != incremental.fingerprint(df.where("id < 49"), ["id", "v"]).first()


def test_metadata_of_many_parts(spark, tmp_path):
    """Ids that are asked for in vain give defaults where there are more than a million parts too."""
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(40).withColumn("p_partkey", F.expr("p_partkey + IF(p_partkey % 2 = 0, 0, 1000000 - 1)")).write.parquet(str(tmp_path / "part.parquet"))
    query, sql = source_queries.QUERIES["metadata_store"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert rows_of_spark(query(spark, str(tmp_path))) == rows_of_sql(con, sql)
