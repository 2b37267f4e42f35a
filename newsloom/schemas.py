"""Schemas of the tables that jobs read and write, as DDL. Times are timestamp_ntz in UTC."""

RAW_ARTICLES = "source string, title string, url string, published_at timestamp_ntz, summary_raw string, publisher string, tickers array<string>, sec_form_type string, sec_items array<string>, event_type_hint string, arrival long"
SOURCES = "id long, name string, kind string, is_official boolean, enabled boolean"
ARTICLES = (
    "id long, source_id long, publisher string, title string, summary_raw string, url string, canonical_url string, published_at timestamp_ntz, fetched_at timestamp_ntz, "
    "tickers array<string>, content_hash string, clean_text string, injection_score double, matched_rules array<string>, status string, sec_form_type string, sec_items array<string>, event_type_hint string"
)
FETCH_RUNS = "id long, source_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string, items_seen long, items_new long, error string, newest_item_at timestamp_ntz"
STORY_CLUSTERS = (
    "id long, primary_ticker string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, article_count long, publisher_count long, event_type string, is_main_subject boolean, "
    "is_opinion boolean, relevance_score double, visible boolean, classification_model string, classification_prompt_version string, has_primary_source boolean, sec_filing_url string"
)
CLUSTER_MEMBERS = "cluster_id long, article_id long, match_method string, similarity double, needs_llm_check boolean"
STORIES = "id long, cluster_id long, title_bg string, summary_bg string, tickers array<string>, event_type string, is_opinion boolean, verification_status string, model_version string, prompt_version string, created_at timestamp_ntz"
STORY_FACTS = "id long, story_id long, fact_order int, text_bg string, verification_status string"
FACT_EVIDENCE = "id long, fact_id long, article_id long, quote_en string, quote_start int, quote_end int"
VERIFICATION_LOG = "story_id long, fact_id long, check string, passed boolean, details string, created_at timestamp_ntz"
LLM_CALLS = "id long, purpose string, model string, prompt_version string, input_tokens long, output_tokens long, cost_usd double, latency_ms long, status string, created_at timestamp_ntz"
STORY_VERSIONS = "cluster_id long, version_num long, replaced_at timestamp_ntz, reason string, snapshot_json string, model_version string, prompt_version string"
RESPONSE_CACHE = "cache_key string, purpose string, model string, prompt_version string, response_text string, input_tokens long, output_tokens long, hit_count long, created_at timestamp_ntz, last_hit_at timestamp_ntz"
GOLDEN = "id string, category string, articles array<struct<id: long, ticker: string, publisher: string, title: string, clean_text: string>>, expected_is_opinion boolean, expected_quarantined boolean, expected_injection_suspected boolean, must_not_include array<string>"

#: Response schemas, with keys that may be missing listed apart.
EVENT_TYPES = ["earnings", "merger_acquisition", "product_launch", "regulatory", "executive_change", "legal", "macro", "analyst_opinion", "promotional", "other"]
EVIDENCE = "array<struct<article_id: long, quote_en: string>>"
CLASSIFICATION = "cluster_id long, is_main_subject boolean, event_type string, is_opinion boolean, relevance_score double, injection_suspected boolean, injection_reason string, rationale_en string"
SAME_EVENT = "same_event boolean, confidence double, rationale_en string"
CORROBORATION = "matches boolean, confidence double, rationale_en string"
SUMMARY = (
    "cluster_id long, title_bg string, summary_bg string, key_facts array<struct<text_bg: string, evidence: " + EVIDENCE + ">>, "
    "attributed_opinions array<struct<who: string, publisher: string, opinion_bg: string, evidence: " + EVIDENCE + ">>, uncertainties_bg array<string>, injection_suspected boolean"
)
JUDGEMENT = "fact_id long, support string, missing_or_added_bg string"
RECHECK = "is_injection boolean, reason string"
