"""Enforced schemas of the input tables and of the stored memory tables."""

from __future__ import annotations

#: DDL text, usable wherever Spark takes a schema. Source tables; timestamps without zone are read as NTZ and cast in views.py.
INPUT = {
    "region": ("r_regionkey int, r_name string"),
    "nation": ("n_nationkey int, n_name string, n_regionkey int"),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
    "documents": ("doc_id bigint, text string, lang string, source string, n_chars bigint"),
    "embeddings": ("vec_id bigint, embedding array<float>, label int"),
    "pages": ("page_id bigint, url string, html string"),
    "benchmark": ("item_id bigint, text string"),
    "labels": ("doc_id bigint, quality int, toxic int"),
    "conversations": ("conv_id bigint, turn bigint, role string, text string"),
}

#: Stored memory tables (flags are BOOLEAN, times TIMESTAMP, nested data typed).
MEMORY = {
    "observations": (
        "id string, type string, content string, summary string, "
        "metadata struct<source:string, file_path:string, tokens_original:bigint, tokens_summarized:bigint, "
        "files_modified:array<string>, significance_flags:array<string>, entities:array<string>>, "
        "embedding array<float>, indexed_at timestamp, privacy_level string, session_id string, "
        "content_hash string, correlation_id string, access_count bigint, importance_score double, "
        "pinned boolean, compression_tier string, last_useful_at timestamp"
    ),
    "knowledge": (
        "id string, category string, title string, content string, tags array<string>, shareable boolean, "
        "relevance_score double, access_count bigint, created_at timestamp, archived boolean, "
        "source_type string, last_accessed timestamp, stale boolean, auto_promoted boolean, "
        "contradiction_count bigint, valid_from timestamp, valid_to timestamp, superseded_by string, "
        "last_useful_at timestamp, source_projects array<string>"
    ),
    "events": (
        "id string, session_id string, event_type string, priority int, agent string, data string, "
        "context_bytes bigint, ts timestamp"
    ),
    "token_stats": ("session_id string, event_type string, tokens_in bigint, tokens_out bigint, ts timestamp"),
    "content_chunks": ("source_hash string, source string, chunk_index int, heading string, content string, has_code boolean"),
    "entities": ("name string, type string, knowledge_id string, canonical string, aliases array<string>"),
    "relationships": ("src string, dst string, type string, weight double, updated_at timestamp"),
    "topics": ("observation_id string, topic string, confidence double"),
    "session_chains": (
        "session_id string, chain_id string, parent_session string, project string, reason string, "
        "summary string, token_estimate bigint, created_at timestamp"
    ),
    "access_log": ("knowledge_id string, session_id string, accessed_at timestamp"),
    "snapshots": ("session_id string, snapshot map<string,string>, created_at timestamp"),
    "merge_suggestions": (
        "local_id string, global_id string, similarity double, strategy string, status string, created_at timestamp"
    ),
}
