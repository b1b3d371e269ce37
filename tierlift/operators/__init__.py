"""Reusable DataFrame operators (each takes and returns DataFrames)."""

from .cohort import (balanced_users, control_counts, eligible_users, full_eligible, ranked_users,
                     status_split, target_counts)
from .dimension import tier_dimension
from .facts import (classified_transactions, per_user_facts, treatment_orders_by_class,
                    user_post_launch, user_post_launch_string_keys)
from .ranking import bucketed_row_number, k_smallest_per_group
from .segments import counts_by, pct_of_counts, pct_of_group, top_n_with_other, value_ranks
from .windowing import txn_window_scan, window_txn_counts

__all__ = [
    "balanced_users", "bucketed_row_number", "classified_transactions", "control_counts",
    "counts_by", "eligible_users", "full_eligible", "k_smallest_per_group", "pct_of_counts",
    "pct_of_group", "per_user_facts", "ranked_users", "status_split", "target_counts",
    "tier_dimension", "top_n_with_other", "treatment_orders_by_class", "txn_window_scan",
    "user_post_launch", "user_post_launch_string_keys", "value_ranks", "window_txn_counts",
]
