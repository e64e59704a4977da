"""Weights and thresholds of the match, all overridable."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    weight_vector: float = 0.20
    weight_skill: float = 0.25
    weight_experience: float = 0.15
    weight_education: float = 0.05
    weight_domain: float = 0.10
    weight_location: float = 0.15
    weight_salary: float = 0.10
    skill_required: float = 0.60
    skill_optional: float = 0.25
    skill_bonus: float = 0.15
    experience_core: float = 0.60
    experience_bonus: float = 0.15
    experience_total: float = 0.25
    min_degree_weight: float = 0.50
    prefer_degree_weight: float = 0.20
    required_major_weight: float = 0.20
    preferred_major_weight: float = 0.10
    degree_gate: float = 0.50
    salary_ratio: float = 1.50
    direction_tags: int = 3
    tier_reach: float = 1.20
    tier_safety: float = 0.85
    semantic_min: float = 0.88
    semantic_base: float = 0.55
    semantic_scale: float = 2.5
    semantic_max: float = 0.85
    primary_below: float = 0.35
    primary_penalty: float = 0.70
    required_below: float = 0.45
    required_penalty: float = 0.82
    title_floor: float = 0.60
    specialized_penalty: float = 0.72
    #: (largest pool, factor); larger pools take the last factor.
    recall_steps: tuple = ((50, 3), (200, 5), (1000, 8), (None, 10))
    recall_filtered_scale: int = 2
    recall_filtered_min: int = 8


DEFAULT = MatchConfig()
