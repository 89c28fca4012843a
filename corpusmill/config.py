"""Settings of retrieval, chunking and evidence selection.

Every setting is declared once with its default and its allowed range; groups
of weights are scaled to sum to one. Values outside a range are clamped.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

ENV_PREFIX = "CORPUSMILL_"

# Fixed values: (name, smallest, largest); None leaves that side open.
RANGES = (
    ("top_k", 1, None),
    ("chunk_size", 100, None),
    ("chunk_overlap_tokens", 0, None),
    ("parent_chunk_size_tokens", 128, None),
    ("child_chunk_size_tokens", 32, None),
    ("query_rewrite_min_similarity", -1.0, 1.0),
    ("retrieval_candidate_k", 1, None),
    ("metadata_boost_max", 0.0, None),
    ("verifier_auto_accept_score", 0.0, None),
    ("verifier_auto_reject_score", 0.0, None),
    ("verifier_min_keyword_score", 0.0, None),
    ("verifier_min_embedding_score", 0.0, None),
    ("verifier_context_chars", 100, None),
    ("hybrid_max_top_k", 1, None),
    ("hybrid_rrf_k", 1, None),
    ("query_complexity_threshold", 1.0, None),
    ("simple_query_top_k", 1, None),
    ("multi_query_max_variants", 2, 8),
    ("hybrid_bm25_k1", 0.01, None),
    ("hybrid_bm25_b", 0.0, 1.0),
    ("hybrid_min_bm25_score", 0.0, None),
    ("hybrid_min_embedding_score", -1.0, 1.0),
    ("evidence_focus_top_k", 1, None),
    ("evidence_focus_max_chars", 120, None),
    ("fine_evidence_chunk_chars", 80, None),
    ("fine_evidence_chunk_fraction", 0.05, 1.0),
    ("fine_evidence_overlap_chars", 0, None),
    ("fine_evidence_top_k", 1, None),
    ("fine_evidence_max_groups", 1, None),
    ("fine_evidence_min_embedding_score", -1.0, 1.0),
)
# Weights that share one unit, with the split used when all are zero.
WEIGHT_GROUPS = (
    (("keyword_weight", 0.5), ("embedding_weight", 0.5)),
    (
        ("rerank_fusion_weight", 0.30), ("rerank_bm25_weight", 0.32), ("rerank_embedding_weight", 0.26),
        ("rerank_coverage_weight", 0.10), ("rerank_phrase_weight", 0.02),
    ),
    (("evidence_focus_keyword_weight", 0.80), ("evidence_focus_embedding_weight", 0.20)),
    (("fine_evidence_keyword_weight", 0.55), ("fine_evidence_embedding_weight", 0.45)),
)
# Settings with a closed list of names.
CHOICES = (
    ("chunk_strategy", ("dynamic", "boundary", "hard")),
    ("hybrid_fusion_method", ("rrf", "lambdamart")),
    ("evidence_gate_mode", ("strict", "relaxed")),
)


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    chunk_size: int = 600
    chunk_stride: int = 600
    chunk_strategy: str = "dynamic"
    chunk_overlap_tokens: int = 200
    parent_child_enabled: bool = True
    parent_chunk_size_tokens: int = 1024
    child_chunk_size_tokens: int = 256
    parent_chunk_overlap_tokens: int = 0
    child_chunk_overlap_tokens: int = 0
    query_rewrite_semantic_enabled: bool = True
    query_rewrite_min_similarity: float = 0.60
    retrieval_candidate_k: int = 100
    keyword_weight: float = 0.6
    embedding_weight: float = 0.4
    metadata_boost_max: float = 0.18
    verifier_auto_accept_enabled: bool = False
    verifier_auto_accept_score: float = 0.52
    verifier_auto_reject_score: float = 0.15
    verifier_min_keyword_score: float = 8.0
    verifier_min_embedding_score: float = 0.35
    verifier_context_chars: int = 600
    hybrid_top_k: int = 5
    rerank_top_k: int = 5
    hybrid_candidate_k: int = 100
    hybrid_max_top_k: int = 12
    hybrid_max_candidate_k: int = 200
    hybrid_rrf_k: int = 60
    hybrid_fusion_method: str = "rrf"
    complexity_routing_enabled: bool = True
    query_complexity_threshold: float = 2.0
    simple_query_top_k: int = 5
    multi_query_enabled: bool = True
    multi_query_max_variants: int = 2
    hybrid_bm25_k1: float = 1.4
    hybrid_bm25_b: float = 0.72
    hybrid_min_bm25_score: float = 1.0
    hybrid_min_embedding_score: float = 0.32
    hybrid_high_embedding_score: float = 0.48
    evidence_gate_mode: str = "strict"
    rerank_fusion_weight: float = 0.30
    rerank_bm25_weight: float = 0.32
    rerank_embedding_weight: float = 0.26
    rerank_coverage_weight: float = 0.10
    rerank_phrase_weight: float = 0.02
    evidence_focus_enabled: bool = False
    evidence_focus_top_k: int = 4
    evidence_focus_max_chars: int = 480
    evidence_focus_keyword_weight: float = 0.80
    evidence_focus_embedding_weight: float = 0.20
    fine_evidence_enabled: bool = False
    fine_evidence_chunk_chars: int = 240
    fine_evidence_chunk_fraction: float = 1.0 / 3.0
    fine_evidence_overlap_chars: int = 32
    fine_evidence_top_k: int = 6
    fine_evidence_max_groups: int = 3
    fine_evidence_keyword_weight: float = 0.55
    fine_evidence_embedding_weight: float = 0.45
    fine_evidence_min_embedding_score: float = 0.45

    def normalized(self) -> "Settings":
        return replace(self, **_clamped(self))

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None) -> "Settings":
        """Defaults overridden by ``CORPUSMILL_<NAME>``; unreadable values are ignored."""
        env = os.environ if env is None else env
        given = {}
        for field in fields(Settings):
            raw = env.get(ENV_PREFIX + field.name.upper())
            if raw is None or not str(raw).strip():
                continue
            kind = type(field.default)
            try:
                given[field.name] = str(raw).strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
            except ValueError:
                continue
        return Settings(**given).normalized()


def _clamp(value, low, high):
    if low is not None and value < low:
        return low
    return high if high is not None and value > high else value


def _clamped(s: Settings) -> dict:
    out: dict = {name: _clamp(getattr(s, name), low, high) for name, low, high in RANGES}
    for group in WEIGHT_GROUPS:
        kept = {name: max(0.0, float(getattr(s, name))) for name, _ in group}
        total = sum(kept.values())
        out.update({name: (kept[name] / total if total > 0 else default) for name, default in group})
    for name, allowed in CHOICES:
        value = str(getattr(s, name)).strip().lower()
        out[name] = value if value in allowed else allowed[0]
    out["chunk_stride"] = _clamp(s.chunk_stride, 1, out["chunk_size"])
    out["parent_chunk_overlap_tokens"] = _clamp(s.parent_chunk_overlap_tokens, 0, out["parent_chunk_size_tokens"] - 1)
    out["child_chunk_overlap_tokens"] = _clamp(s.child_chunk_overlap_tokens, 0, out["child_chunk_size_tokens"] - 1)
    out["hybrid_max_candidate_k"] = max(out["hybrid_max_top_k"], s.hybrid_max_candidate_k)
    out["hybrid_top_k"] = _clamp(s.hybrid_top_k, 1, out["hybrid_max_top_k"])
    out["rerank_top_k"] = _clamp(s.rerank_top_k, 1, out["hybrid_max_candidate_k"])
    out["hybrid_candidate_k"] = _clamp(s.hybrid_candidate_k, 1, out["hybrid_max_candidate_k"])
    low = s.hybrid_min_embedding_score
    out["hybrid_high_embedding_score"] = min(max(low, s.hybrid_high_embedding_score), 1.0)
    if out["hybrid_fusion_method"] == "rrf":
        # The rank-fusion route answers with five contexts unless told otherwise.
        out["simple_query_top_k"] = max(5, out["simple_query_top_k"])
        if out["hybrid_top_k"] == 8:
            out["hybrid_top_k"] = 5
    return out
