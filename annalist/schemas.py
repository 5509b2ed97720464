"""Schemas of the stored relations and transient records (SNK13)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def _s(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_L, _I, _S, _B, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()
USERS = _s(id=_L, username=_S, access_token=_S, created_at=_TS)
REPOSITORIES = _s(id=_L, full_name=_S, user_id=_L, webhook_id=_L, is_active=_B, created_at=_TS, documented_head_sha=_S)
DOCUMENTATIONS = _s(id=_L, repository_id=_L, function_name=_S, file_path=_S, content=_S, commit_sha=_S, score=_I, created_at=_TS, is_deleted=_B)
FUNCTION_REGISTRY = _s(id=_L, repository_id=_L, file_path=_S, function_name=_S, content_hash=_S, updated_at=_TS, is_deleted=_B)
COMMITS = _s(repository_id=_L, sha=_S, short_sha=_S, message=_S, author=_S, commit_date=_S, parents=T.ArrayType(_S), is_merge=_B, pos=_L)
FUNCTION_TASKS = _s(task_id=_L, repository_id=_L, file_path=_S, source=_S, mode=_S, existing_documentation=_S, queued_at=_TS)
EXTRACTED = _s(name=_S, source=_S, language=_S, callees=T.ArrayType(_S), has_error=_B, pos=_I)
_COMMIT_FILES = _s(added=T.ArrayType(_S), modified=T.ArrayType(_S), removed=T.ArrayType(_S))
PUSH = T.StructType([
    T.StructField("repository", _s(full_name=_S)),
    T.StructField("pusher", _s(name=_S)),
    T.StructField("ref", _S),
    T.StructField("after", _S),
    T.StructField("commits", T.ArrayType(_COMMIT_FILES)),
])
RELATIONS = {"users": USERS, "repositories": REPOSITORIES, "documentations": DOCUMENTATIONS, "function_registry": FUNCTION_REGISTRY}


def create_all(spark: SparkSession, root: str) -> None:
    """Writes each relation that isn't there yet as an empty table."""
    from annalist.session import filesystem

    for name, schema in RELATIONS.items():
        fs, p = filesystem(spark, f"{root}/{name}.parquet")
        if not fs.exists(p):
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
