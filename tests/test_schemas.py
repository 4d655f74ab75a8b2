"""Schema evolution, and maps with a key that comes twice."""

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from tidewater.functions import schemas
from tidewater.operators import grouping

text = lambda n, null=True: StructField(n, StringType(), null)
BASE = StructType([text("data1"), text("data2")])
MORE = StructType([*BASE, text("data3")])
MUST = StructType([*BASE, text("data3", False)])


def test_added_and_missing_fields():
    assert schemas.can_read(BASE, MORE) and schemas.can_read(MORE, BASE)
    assert not schemas.can_read(MUST, BASE) and not schemas.can_read(MUST, MORE)
    assert schemas.can_read(MORE, MUST)


@pytest.mark.parametrize("reader, writer, fits", [("a bigint", "a int", True), ("a int", "a bigint", False), ("a double", "a float", True), ("a binary", "a string", True), ("a string", "a int", False), ("a array<bigint>", "a array<int>", True), ("a map<string,struct<x:int,y:int>>", "a map<string,struct<x:int>>", True), ("a array<int>", "a map<string,int>", False)])
def test_types(spark, reader, writer, fits):
    assert schemas.can_read(StructType.fromDDL(reader), StructType.fromDDL(writer)) is fits


def test_all_versions():
    def fail(e):
        def ask():
            raise e

        return ask

    assert schemas.compatible(BASE, lambda: [BASE, MORE]) and schemas.compatible(MUST, lambda: [])
    assert not schemas.compatible(MUST, lambda: [MUST, BASE])
    assert schemas.compatible(MUST, fail(schemas.UnknownSubject()))
    assert not schemas.compatible(BASE, fail(schemas.RegistryError()))
    assert schemas.compatible(BASE, fail(OSError()))


def test_map_with_a_repeated_key(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "g string, k string, v int")
    assert {r["g"]: r["entries"] for r in grouping.to_map(df, "g", "k", "v").collect()} == {"a": {"x": 1, "y": 2}, "b": {"x": 3}}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        grouping.to_map(df.union(df), "g", "k", "v").collect()
