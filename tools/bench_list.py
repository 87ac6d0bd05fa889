"""Headline queries timed by bench.py."""

HEADLINE = [
    "user_features", "item_stats", "session_features", "item_cooccurrence", "item_similarity",
    "hourly_kpis", "cold_start_cohorts", "request_diversity", "pit_features", "assign_variants",
    "ab_significance", "recall_candidates", "recommend", "inventory_replay", "price_change",
    "cart_totals", "checkout_funnel", "product_search_boosted", "instant_interest",
    "impressions", "cold_start_score_gap", "ctr_model_scores",
]
