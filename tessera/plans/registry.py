"""Names of the engine's queries, with their DuckDB oracles."""

from __future__ import annotations

from ..operators import bridge, demand, emerging, fusion, growth, learning, shared
from ..streaming import ingest
from . import oracles

_NAMES = {
    shared: "snapshot_latest commenter_hash retention_30d channel_semi orphan_check",
    growth: "indicators channel_relative label_above_baseline label_top_quartile time_split channel_similarity pooled_mean confidence_level underperformers linear_shap opportunity_view",
    demand: "clean_text language_route weak_majority_vote weak_label_model cohen_kappa pseudo_labels demand_dist supply_dist demand_supply_jsd jsd_contrib jsd_monthly_delta jsd_weekly_delta demand_gap_weekly w1_ordered sinkhorn unmet_topk demand_gap_view ctfidf_topterms",
    bridge: "graph_edges ppr_topk shared_audience_conf bridge_score bridge_rank ppr_topk_by_target shared_audience_by_target bridge_score_by_target bridge_rank_by_target bridge_weekly modularity louvain metapath_vectors node2vec_walks",
    emerging: "prevalence_dense hier_pool kalman_level forecast_var bocpd_shortrun emerging_flag alert_view prevalence_weekly kalman_level_weekly forecast_var_weekly bocpd_shortrun_weekly emerging_flag_weekly alert_view_weekly",
    fusion: "fusion_score fusion_contributions recommend_topk",
    learning: "random_forest gradient_boosting similarity_weighted feature_importance tree_shap intent_classifier topic_clusters",
    ingest: "stream_weekly_counts",
}
QUERIES = {name: getattr(module, name) for module, names in _NAMES.items() for name in names.split()}
ORACLES = dict(oracles.ORACLES) | {
    "stream_weekly_counts": "SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM events GROUP BY ALL",
}
