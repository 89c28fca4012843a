"""Profiles: a folder of tables plus a JSON configuration, and their sinks."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.access import require_scope
from corpusmill.operators.catalogue import valid_profile_name
from corpusmill.operators.embed import fingerprint

SCOPE_COLUMNS = ("tenant_id", "kb_id", "index_version_id")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def write_scoped(df: DataFrame, root: str, name: str) -> None:
    """Append rows under their tenant / base / version partition."""
    df.write.mode("append").partitionBy(*SCOPE_COLUMNS).parquet(f"{root}/{name}")


def read_scoped(spark: SparkSession, root: str, name: str, scope: tuple[str, str, str]) -> DataFrame:
    """Rows of one scope; the filters prune partitions."""
    require_scope(scope)
    table = read_table(spark, root, name)
    for column, value in zip(SCOPE_COLUMNS, scope):
        table = table.filter(table[column] == value)
    return table


def write_embeddings(chunks: DataFrame, root: str, model: str) -> None:
    """Embeddings together with the metadata that says when they may be reused."""
    chunks.select("chunk_id", "embedding").write.mode("overwrite").parquet(f"{root}/embeddings")
    digest = fingerprint(chunks)
    digest.selectExpr(f"'{model}' AS model", "chunk_count", "fingerprint").write.mode("overwrite").parquet(f"{root}/embeddings_meta")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "canonical string, type string, aliases array<string>, related_terms array<string>, "
        "triggers array<struct<all:array<string>,any:array<string>>>"
    )
    return spark.read.schema(schema).json(path, multiLine=True)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a graph file."""
    schema = (
        "entities array<struct<id:string,name:string,type:string,aliases:array<string>>>, "
        "relations array<struct<source:string,target:string,type:string,confidence:double,supporting_chunk_ids:array<string>>>"
    )
    raw = spark.read.schema(schema).json(path, multiLine=True)
    entities = raw.selectExpr("inline(entities)").withColumnRenamed("id", "entity_id")
    relations = raw.selectExpr("posexplode(relations) AS (relation_id, r)").select("relation_id", "r.*")
    return entities, relations


def profile_config(root: str, name: str, default: str = "default") -> dict:
    """Configuration of one profile; it is a small file read on the driver."""
    name = name or default
    if not valid_profile_name(name):
        raise ValueError(f"invalid profile name {name!r}")
    with open(os.path.join(root, name, "retrieval.json"), encoding="utf-8") as handle:
        config = json.load(handle)
    if not isinstance(config, dict):
        raise ValueError("profile configuration must be an object")
    return config


def profile_names(root: str, default: str = "default") -> list[str]:
    names = sorted(
        n for n in os.listdir(root) if valid_profile_name(n) and os.path.isfile(os.path.join(root, n, "retrieval.json"))
    )
    return sorted(names, key=lambda n: (n != default, n))
