"""Tables of the knowledge store, and adapters that give the supplied tables their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.runtime import table

_L, _I, _S, _TS, _B = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType(), T.BinaryType()


def _struct(required: dict, optional: dict | None = None) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in required.items()]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in (optional or {}).items()])


#: Name -> schema; every table has a BIGINT key.
TABLES: dict[str, T.StructType] = {
    "agent_datasets": _struct({"id": _L, "subject": _S, "dataset_id": _L, "created_at": _TS}),
    "agent_runs": _struct({"id": _L, "run_id": _S, "session_id": _S, "requested_by": _S, "user_message": _S, "status": _S, "created_at": _TS, "updated_at": _TS}, {"checkpoint_id": _S, "approval_id": _S, "error_code": _S, "turn_id": _S}),
    "approvals": _struct({"id": _L, "approval_id": _S, "status": _S, "tool": _S, "requester": _S, "created_at": _TS}, {"session_id": _S, "turn_id": _S, "arguments_hash": _S, "display_arguments": _S, "expires_at": _TS, "checkpoint_id": _S, "interrupt_id": _S, "run_id": _S, "decided_by": _S, "decided_at": _TS, "executed_at": _TS}),
    "audit_events": _struct({"id": _L, "event_type": _S, "created_at": _TS}, {"session_id": _S, "approval_id": _S, "tool": _S, "payload": _S, "actor_subject": _S}),
    "chat_turns": _struct({"id": _L, "turn_id": _S, "session_id": _S, "status": _S, "created_at": _TS}, {"approval_id": _S, "error": _S, "completed_at": _TS}),
    "checkpoints": _struct({"id": _L, "checkpoint_id": _S, "payload": _B, "expires_at": _TS}),
    "datasets": _struct({"id": _L, "name": _S, "visibility": _S, "status": _S, "created_at": _TS}, {"type": _S, "description": _S}),
    "documents": _struct({"id": _L, "title": _S, "source": _S, "status": _S, "visibility": _S, "dataset_id": _L}, {"owner_subject": _S, "metadata": _S, "folder_id": _L}),
    "document_chunks": _struct({"id": _L, "document_id": _L, "chunk_index": _I, "content": _S, "vector_status": _S}, {"metadata": _S}),
    "knowledge_folders": _struct({"id": _L, "dataset_id": _L, "name": _S, "path": _S}, {"parent_id": _L, "sort": _I}),
    "knowledge_indexes": _struct({"id": _L, "embedding_model": _S, "dimensions": _I, "status": _S}),
    "sessions": _struct({"id": _L, "session_id": _S, "owner": _S, "created_at": _TS}),
    "session_messages": _struct({"id": _L, "session_id": _L, "role": _S, "content": _S, "created_at": _TS}),
}

# The states that each status column may hold.
STATES = {
    "agent_runs.status": ("RUNNING", "INTERRUPTED", "RESUMING", "COMPLETED", "FAILED", "EXPIRED"),
    "approvals.status": ("PENDING", "APPROVED", "REJECTED", "EXPIRED", "RESUMING", "EXECUTED"),
    "chat_turns.status": ("RUNNING", "INTERRUPTED", "COMPLETED", "FAILED"),
    "datasets.visibility": ("system", "private"),
    "datasets.status": ("ACTIVE", "DISABLED"),
    "document_chunks.vector_status": ("pending", "indexed", "failed", "deleting"),
    "knowledge_indexes.status": ("BUILDING", "ACTIVE", "RETIRED", "FAILED"),
}


def check_states(df: DataFrame, column: str, name: str) -> DataFrame:
    """df, failing at run time on a state outside the allowed ones."""
    ok = F.col(column).isin(*STATES[name])
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"invalid {name}: "), F.coalesce(F.col(column), F.lit("null"))))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied documents as knowledge documents: title, dataset, visibility and owner derived."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("title"), "source", "lang", "text", "n_chars",
        (F.col("doc_id") % 5 + 1).alias("dataset_id"), F.when(F.col("doc_id") % 3 == 0, "private").otherwise("system").alias("visibility"),
        F.col("source").alias("owner_subject"),
    )


#: The same adapter for the oracle.
DOCUMENTS_SQL = """
SELECT doc_id AS id, source || '-' || doc_id AS title, source, lang, text, n_chars, doc_id % 5 + 1 AS dataset_id,
       CASE WHEN doc_id % 3 = 0 THEN 'private' ELSE 'system' END AS visibility, source AS owner_subject FROM documents
"""


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as approvals: status from the order's, expiry and decision from its date and priority."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "APPROVED").when(F.col("o_orderkey") % 2 == 0, "REJECTED").otherwise("EXECUTED")
    return o.select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_custkey").alias("requester"), F.col("o_orderdate").alias("expires_at"),
        F.when(~status.isin("PENDING"), F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("decided_at"), F.col("o_orderpriority").alias("tool"),
    )


APPROVALS_SQL = """
SELECT *, CASE WHEN status <> 'PENDING' THEN expires_at - INTERVAL 1 DAY END AS decided_at FROM (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'APPROVED'
         WHEN o_orderkey % 2 = 0 THEN 'REJECTED' ELSE 'EXECUTED' END AS status,
         o_custkey AS requester, o_orderdate AS expires_at, o_orderpriority AS tool FROM orders)
"""
