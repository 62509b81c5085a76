"""Operators by phase: building, asking models, checking and scoring, analysis, validation."""

from mixlens.operators.analysis import category_profile, compliance_by_level, compliance_overall, constraint_profile, level_profile, level_scores, pdr_by_level, pdr_details, radar, robustness, robustness_chart, summary, wlr_ranking
from mixlens.operators.build import build as build_dataset
from mixlens.operators.build import build_report, fill, flatten_sample
from mixlens.operators.classify import classify as category_of
from mixlens.operators.classify import targets, with_custom
from mixlens.operators.constraints import check, check_all, derive, embed, pass_rate
from mixlens.operators.evaluate import composite, last_wins, lookup, pending, score_batch, unpivot_levels
from mixlens.operators.evaluate import evaluate as evaluate_records
from mixlens.operators.providers import embedding_f1, gold_with, infer, probe, rewrite_levels, rewrite_with
from mixlens.operators.selection import finalize_ids, is_local_url, quota_sample, resolve_credentials, select_models, train_test
from mixlens.operators.validation import full_report, marker_coverage, violations

__all__ = [
    "build_dataset", "build_report", "category_of", "category_profile", "check", "check_all", "compliance_by_level", "compliance_overall", "composite", "constraint_profile", "derive", "embed", "embedding_f1",
    "evaluate_records", "fill", "finalize_ids", "flatten_sample", "full_report", "gold_with", "infer", "is_local_url", "last_wins", "level_profile", "level_scores", "lookup", "marker_coverage", "pass_rate",
    "pdr_by_level", "pdr_details", "pending", "probe", "quota_sample", "radar", "resolve_credentials", "rewrite_levels", "rewrite_with", "robustness", "robustness_chart", "score_batch", "select_models", "summary",
    "targets", "train_test", "unpivot_levels", "violations", "with_custom", "wlr_ranking",
]

