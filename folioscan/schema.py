"""Row types of the engine."""

from __future__ import annotations

CHUNK = "chunk_id string, source string, file_path string, chunk_index int, content string, extra map<string,string>"
INDEX = CHUNK + ", buckets array<int>, weights array<double>"
QUESTION = "query_id long, question string, top_k int, with_sources boolean"
SOURCES = "array<struct<file:string,chunk_id:string,score:double>>"
RISK = "struct<is_honest:boolean,has_citation:boolean,risk_level:string>"
ANSWER = f"query_id long, answer string, sources {SOURCES}, context_used int, hallucination_risk {RISK}, query string, error string"
INGEST = "success long, failed long, total_chunks long, vector_count long"
SIGNATURE = "array<struct<name:string,size:long,mtime:long>>"
MANIFEST = f"signature struct<files:{SIGNATURE},params:string>, last_stats struct<success:long,failed:long,total_chunks:long,vector_count:long>"
