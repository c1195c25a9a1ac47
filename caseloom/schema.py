"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampNTZType()

DOCUMENT = "content string, source string, page int, file_type string, metadata_extra map<string,string>"

CHUNKS = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("case_id", _S), T.StructField("content", _S),
        T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("source", _S),
        T.StructField("page", _I), T.StructField("chunk_index", _I), T.StructField("total_chunks", _I),
        T.StructField("doc_type", _S), T.StructField("entity_name", _S), T.StructField("effective_date", _TS),
        T.StructField("message_id", _S), T.StructField("thread_id", _S), T.StructField("parent_message_id", _S),
        T.StructField("email_subject", _S), T.StructField("email_from", _S), T.StructField("email_to", _S),
        T.StructField("email_date", _TS), T.StructField("chunk_type", _S), T.StructField("attachment_names", _S),
        T.StructField("body_only", _S), T.StructField("metadata_extra", T.MapType(_S, _S)),
    ]
)

EVALUATION_SET = "query string, expected_sources array<string>, expected_answer_keywords array<string>, expected_answer_contains array<string>, expected_answer string"
AUDIT_EVENT = "event_type string, timestamp string, user string, ip_address string, case_id string, details string, severity string, request_id string"
