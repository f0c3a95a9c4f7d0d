"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import exact_dedup, line_dedup, minhash_dedup, mixing, packing, pii, quality, secrets, sharding, spotsigs

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_minhash_dedup": minhash_dedup.op2_minhash_dedup,
    "op3_dp_packing": packing.op3_dp_packing,
    "op4_hilbert_shards": sharding.op4_hilbert_shards,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_spotsigs": spotsigs.op7_spotsigs,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_pii": pii.op10_pii,
}

SQL = {
    "op5_source_mix": mixing.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
