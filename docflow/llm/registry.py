"""The queries of the corpus operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import importlib

#: (module, query function, name of its SQL constant or None)
_TABLE = [
    ("decontaminate", "op1_benchmark_decontamination", "OP1_SQL"),
    ("mixing", "op2_hierarchical_mixing", "OP2_SQL"),
    ("near_dup", "op3_minhash_near_dup", "OP3_SQL"),
    ("warc", "op4_warc_salvage", None),
    ("urls", "op5_blocked_bloom_url_filter", "OP5_SQL"),
    ("tokens", "op6_digest_cache_tokens", None),
    ("vectors", "op7_rotated_code_near_dup", "OP7_SQL"),
    ("shard", "op8_sampled_splitter_shards", None),
    ("substring", "op9_substring_dedup", "OP9_SQL"),
    ("quality", "op10_quality_classifier", None),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for module, name, _ in _TABLE}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), sql) for module, name, sql in _TABLE if sql}
