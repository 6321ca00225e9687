import json

from pyspark.sql import functions as F

from ruleloom.streaming.ingest import REGISTRY, ingest


def _drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"url": u, "text": t}) + "\n" for u, t in rows))


def test_ids_stay_and_contents_count_once(spark, tmp_path):
    source, registry = tmp_path / "in", str(tmp_path / "registry")
    run = lambda: ingest(spark, str(source), registry, str(tmp_path / "state")).awaitTermination()
    read = lambda: {r.sha: (r.id, r.url) for r in spark.read.schema(REGISTRY).option("recursiveFileLookup", True).parquet(registry).collect()}
    _drop(source, "a.json", [("u1", "one"), ("u2", "two"), ("u9", "one"), ("u0", None)])
    run()
    first = read()
    assert sorted(i for i, _ in first.values()) == [1, 2, 3]
    assert {u for _, u in first.values()} == {"u0", "u1", "u2"}
    _drop(source, "b.json", [("u3", "two"), ("u4", "four")])
    run()
    second = read()
    assert first.items() <= second.items() and sorted(i for i, _ in second.values()) == [1, 2, 3, 4]


def test_late_events_in_a_stream_are_counted_by_hour(spark, sf_dir, tmp_path):
    from ruleloom.streaming.ingest import hourly_counts

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    hourly_counts(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT sum(n) FROM hours").first()[0] == events.count()


def test_registry_over_three_batches(spark, tmp_path):
    from ruleloom.streaming import registry as rg

    source, where = tmp_path / "in", str(tmp_path / "registry")
    manifest = spark.createDataFrame([("m1", "FR", False), ("m2", "Lyon, FR", True), ("m3", "FR", False), ("m3", "Lyon, FR", False)], "url string, jurisdiction string, has_text boolean")

    def drop(name, rows):
        source.mkdir(exist_ok=True)
        (source / name).write_text("".join(json.dumps({"url": u, "text": t, "jurisdiction": j}) + "\n" for u, t, j in rows))
        rg.ingest(spark, str(source), where, manifest, str(tmp_path / "state")).awaitTermination()
        got = spark.read.option("recursiveFileLookup", True).parquet(f"{where}/decisions").collect()
        return {r.url: (r.decision, r.id, r.note) for r in got if r.batch == max(x.batch for x in got)}

    first = drop("a.json", [("u1", "one", "FR"), ("u2", "two", None), ("m1", "three", None), ("m2", "four", "Lyon, FR"), ("m3", "five", None), ("u4", "six", "Bonn, DE")])
    assert {u: x[0] for u, x in first.items()} == {"u1": "new", "u2": "refused", "m1": "new", "m2": "refused", "m3": "refused", "u4": "refused"}
    assert sorted(x[1] for x in first.values() if x[1]) == [1, 2] and first["m1"][2] == "supplies a text that the manifest lacks"
    second = drop("b.json", [("u1", "one", None), ("u1", "changed", "FR"), ("u9", "one", "FR"), ("u5", "seven", "Lyon, FR")])
    assert second["u5"][:2] == ("new", 3) and second["u9"] == ("refused", None, "content is known under another address")
    third = drop("c.json", [("u5", "seven", "FR"), ("u1", "one", "FR"), ("u6", None, "FR")])
    assert third == {"u5": ("refused", None, "registered with another jurisdiction"), "u1": ("registered", first["u1"][1], "registered before"), "u6": ("new", 4, None)}
    entries = spark.read.schema(rg.ENTRY).option("recursiveFileLookup", True).parquet(f"{where}/by-content").collect()
    assert sorted(r.id for r in entries) == [1, 2, 3, 4]


def test_ordered_versions(spark, tmp_path):
    import pytest

    from ruleloom.sources import sinks

    path = str(tmp_path / "out")
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("id"), F.when(F.col("id") % 2 == 0, "x").alias("v"))
    first = sinks.write_ordered(rows, ["id"], path)
    files = sorted(p for p in (tmp_path / "out" / first).iterdir() if p.name.startswith("part-"))
    assert [json.loads(line)["id"] for p in files for line in p.read_text().splitlines()] == list(range(1000))
    with pytest.raises(ValueError, match="not written: bad"):
        sinks.write_ordered(rows.limit(3), ["id"], path, spark.createDataFrame([("bad",)], "p string"))
    (tmp_path / "out" / "v-interrupted").mkdir()
    assert sinks.read_ordered(spark, path, "id long, v string").count() == 1000
    second = sinks.write_ordered(rows.limit(5), ["id"], path)
    assert sinks.current(spark, path) == second and sinks.read_ordered(spark, path, "id long, v string").count() == 5
    assert {p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("v-")} == {first, second}
    assert sinks.read_ordered(spark, str(tmp_path / "none"), "id long").count() == 0
