"""Save commands are dealt over partitions by their number."""

from pyspark.sql import functions as F

from memspark.operators import commands, stored


def test_commands_without_a_target_are_dealt_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(stored, "PARTITION_ROWS", 100)
    none = lambda schema: spark.createDataFrame([], schema)
    entities = none("id string, name string, entity_type string, scope string, created_at timestamp, updated_at timestamp")
    rows = spark.range(1000).selectExpr("id AS place", "concat('E ', id) AS name", "'concept' AS entity_type", "'general' AS category", "'' AS scope", "CAST(NULL AS STRING) AS observe", "if(id = 7, 'E 8: uses', if(id = 9, 'nobody: uses', NULL)) AS relate", "CAST(NULL AS STRING) AS session")
    got = commands.save_entities(
        entities, none("id string, entity_id string, content string, category string, source string"), none("id string, from_entity string, to_entity string, relation string, source string, valid_to timestamp"), rows, F.lit("2025-01-01").cast("timestamp")
    )
    created = got["events"].where("event_type = 'entity_created'")
    sizes = [r["count"] for r in created.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 999 and max(sizes) < 300
    assert [r.place for r in got["rejected"].collect()] == [9] and [(r.from_entity, r.to_entity) for r in got["relations"].collect()] == [("e-7", "e-8")]
