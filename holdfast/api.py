"""All public names of the experiment engine in one place."""

from holdfast.functions import derive_seeds, digitize, route, sigmoid
from holdfast.operators.checks import audit_split, check_degenerate_columns, check_exact_duplicates, check_split, column_profile, fingerprint_check, label_conflicts, near_duplicate_pairs, near_label_conflicts, rare_classes
from holdfast.operators.dedup import apply_dedup, dedup_average, dedup_exact, dedup_keep_first, duplicate_pairs
from holdfast.operators.ensembles import ensemble_predict, ensemble_train, fit_ensemble, predict_ensemble, predict_nl, train_nl
from holdfast.operators.hint import augment, build_indicators, oof_splits
from holdfast.operators.holdout import SanctifiedDataset, SanctifiedResult, ValidatedDataset, load_dataset
from holdfast.operators.metrics import bracket_mae, bracket_scores, recap, scores, target_distribution
from holdfast.operators.models import BinConfig, CascadeConfig, EnsembleModel, Model, NLModel, RidgeModel, RoutedModel, StackedModel, build_cascade
from holdfast.operators.nn import NetConfig
from holdfast.operators.preprocess import compute_norm_stats, fold_impute, fold_normalize, fold_safe_preprocess, normalize, out_of_fold_moments
from holdfast.operators.ranks import hash_ranked, ordered, permuted, quantiles
from holdfast.operators.ridge import HierarchicalRidge, ridge_predict, ridge_solve
from holdfast.operators.splits import FoldData, contiguous_folds, expanding_window, grouped_kfold, iter_folds, kfold, membership, sanctified, temporal_split, train_test
from holdfast.plans.experiment import Experiment, Fold, RunResult, print_brackets, print_comparison, print_recap
from holdfast.plans.pipeline import Pipeline, PipelineResult, Step, register_step_type
from holdfast.plans.research import Research
from holdfast.sources.history import Notes, RunHistory, append_run, load_runs
from holdfast.sources.snapshots import load_snapshot, save_snapshot
from holdfast.spec import DataError, DatasetSpec, ExperimentConfig, HoldoutError, RunContext

__all__ = [name for name in dir() if not name.startswith("_")]
