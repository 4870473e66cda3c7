"""The artifact data source: round trips, commits, and the files that filters leave."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from folio.sources import artifact_source as source


@pytest.fixture
def store(spark, tmp_path):
    source.register(spark)
    path = f"file://{tmp_path}/store"

    def put(rows, mode="append", parts=1):
        df = spark.createDataFrame(rows, "family string, entity_id string, body string").withColumns({"document_id": F.lit("d"), "scope": F.lit("page")})
        df.coalesce(parts).write.format(source.NAME).mode(mode).save(path)

    return path, put, lambda: spark.read.format(source.NAME).load(path)


def test_round_trip_and_commits(store):
    path, put, get = store
    put([("ir", "p1", "{}"), ("ir", "p2", None), ("qa", "p1", "é")])
    assert sorted((r["family"], r["entity_id"], r["body"], r["content_hash"]) for r in get().collect()) == [("ir", "p1", "{}", hashlib.sha256(b"{}").hexdigest()[:12]), ("ir", "p2", None, None), ("qa", "p1", "é", hashlib.sha256("é".encode()).hexdigest()[:12])]
    put([("ir", "p3", "x")])
    assert get().count() == 4 and get().select("body").where("family = 'ir' AND entity_id > 'p2'").collect()[0][0] == "x"
    put([("ir", "p9", "new")], "overwrite")
    assert [r["entity_id"] for r in get().collect()] == ["p9"]


def test_a_failed_write_is_not_seen(store):
    path, put, get = store
    put([("ir", "p1", "a")])
    with pytest.raises(Exception, match="entity_id"):
        put([("ir", "p2", "b"), ("ir", None, "c")])
    assert [r["entity_id"] for r in get().collect()] == ["p1"]


def test_nothing_written_yet(spark, tmp_path):
    source.register(spark)
    assert spark.read.format(source.NAME).load(f"file://{tmp_path}/none").count() == 0


def test_filters_leave_few_files(store):
    path, put, get = store
    for family in ("ir", "qa", "render"):
        for k in range(0, 40, 10):
            put([(family, f"p{i:03d}", "{}") for i in range(k, k + 10)])

    def opened(*filters):
        reader = source.ArtifactReader(path)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sum(len(p.names) for p in reader.partitions())

    family, entity = ("family",), ("entity_id",)
    assert opened() == 12 and opened(EqualTo(family, "qa")) == 4 and opened(In(family, ("qa", "ir", "none"))) == 8 and opened(EqualTo(family, "none")) == 0
    assert opened(EqualTo(family, "qa"), EqualTo(entity, "p015")) == 1 and opened(GreaterThan(entity, "p029")) == 6 and opened(LessThanOrEqual(entity, "p000"), IsNotNull(entity)) == 3
    rows = get().where("family = 'qa' AND entity_id BETWEEN 'p008' AND 'p011'")
    assert sorted(r["entity_id"] for r in rows.collect()) == ["p008", "p009", "p010", "p011"]
