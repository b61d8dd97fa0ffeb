"""Schemas of the engine's tables, by name."""

TABLES = {
    "nodes": "id long, type string, name string, content string, metadata string, is_hub boolean",
    "edges": "source long, target long, weight double, src_type string, dst_type string",
    "vectors": "id long, embedding array<float>",
    "memories": (
        "node_id long, mem_key string, status string, kind string, scope string, updated_at long, last_seen long, "
        "last_retrieved long, trust double, strength double"
    ),
    "sessions": "session_id string, entities array<string>, updated_at timestamp",
}
