"""DataFrame -> DataFrame operators."""

from evkit.operators.assoc import (
    association_matrix,
    category_sizes,
    correlation_ratio,
    cramers_v,
    numeric_pairs,
    pearson,
    strong_associations,
)
from evkit.operators.boosting import Boosted, fit_boosted, load_boosted, save_boosted, score_boosted
from evkit.operators.calibrate import calibration_error, isotonic_fit, isotonic_score, reliability
from evkit.operators.categories import category_table, dictionary, encode_categories
from evkit.operators.conform import (
    add_key,
    add_ratio,
    conform_keys,
    drop_incomplete,
    fill_missing,
    qualify,
    recode,
    scale_columns,
    slice_rows,
    split_name,
)
from evkit.operators.entity import entity_profile, entity_vs_average
from evkit.operators.evaluate import confusion_counts, confusion_matrix, evaluate, rank_auc
from evkit.operators.joins import denormalize, duplicate_keys, lookup_mean, require_unique, unmatched_keys
from evkit.operators.model import (
    ReferenceEncoder,
    build_pipeline,
    coefficients,
    compare_models,
    fit,
    lift,
    load_model,
    ordinal_encode,
    save_model,
    score,
    score_scenarios,
    stratified_part,
    stratified_split,
    string_index,
    temporal_split,
    train_model,
)
from evkit.operators.profile import (
    argmax_row,
    both_tails,
    dedupe,
    deviation,
    distinct_values,
    facet_counts,
    frequency_table,
    global_means,
    kpis,
    minmax,
    mode_value,
    rankings,
    top_k,
    value_range,
)
from evkit.operators.ranks import ranked, running_sums
from evkit.operators.value import (
    expected_value,
    over_under,
    over_under_games,
    over_under_pivot,
    summarize_games,
)
from evkit.operators.windows import running_tallies

__all__ = [
    "Boosted",
    "ReferenceEncoder",
    "add_key",
    "add_ratio",
    "argmax_row",
    "association_matrix",
    "both_tails",
    "build_pipeline",
    "calibration_error",
    "category_sizes",
    "category_table",
    "coefficients",
    "compare_models",
    "conform_keys",
    "confusion_counts",
    "confusion_matrix",
    "correlation_ratio",
    "cramers_v",
    "dedupe",
    "denormalize",
    "deviation",
    "dictionary",
    "distinct_values",
    "drop_incomplete",
    "duplicate_keys",
    "encode_categories",
    "entity_profile",
    "entity_vs_average",
    "evaluate",
    "expected_value",
    "facet_counts",
    "fill_missing",
    "fit",
    "fit_boosted",
    "frequency_table",
    "global_means",
    "isotonic_fit",
    "isotonic_score",
    "kpis",
    "lift",
    "load_boosted",
    "load_model",
    "lookup_mean",
    "minmax",
    "mode_value",
    "numeric_pairs",
    "ordinal_encode",
    "over_under",
    "over_under_games",
    "over_under_pivot",
    "pearson",
    "qualify",
    "rank_auc",
    "ranked",
    "rankings",
    "recode",
    "reliability",
    "require_unique",
    "running_sums",
    "running_tallies",
    "save_boosted",
    "save_model",
    "scale_columns",
    "score",
    "score_boosted",
    "score_scenarios",
    "slice_rows",
    "split_name",
    "stratified_part",
    "stratified_split",
    "string_index",
    "strong_associations",
    "summarize_games",
    "temporal_split",
    "top_k",
    "train_model",
    "unmatched_keys",
    "value_range",
]
