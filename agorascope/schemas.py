"""Explicit schemas, enumerated domains and unique keys of the corpus tables."""

from __future__ import annotations




# Provider item as landed on disk (JSON lines).
ITEM_DDL = (
    "id long, type string, `by` string, time long, title string, text string, url string, "
    "score int, descendants int, kids array<long>, parent long, deleted boolean, dead boolean"
)

# ---- Fixed values: enumerated domains of the data contract -------------------------------
SOURCE_KINDS = ("arxiv", "bluesky", "hackernews", "google_news", "reddit", "twitter", "youtube", "exa", "webset")
ARTICLE_KINDS = ("arxiv", "google_news", "exa", "webset")
CATEGORIES = ("discourse", "article")
CONTENT_TYPES = ("post", "comment", "article")
STORY_TYPES = ("lead_story", "secondary_story", "beat_story", "dispatch", "entity_story")
ARC_STATUSES = ("breaking", "developing", "ongoing", "resolved", "archived")
COMPUTED_ARC_STATUSES = ("breaking", "developing")
VARIANT_TYPES = (
    "summary_short", "summary_medium", "briefing_blurb", "social_twitter", "social_linkedin", "email_teaser",
)
CITATION_TYPES = ("internal", "external")
SEVERITIES = ("low", "medium", "high")
EVIDENCE_TARGETS = ("record", "entity", "topic", "story")
SEARCH_KINDS = ("story", "record", "citation", "entity", "topic")
PROJECTION_KINDS = ("story", "citation", "entity", "topic")
SYNC_STATUSES = ("pending", "synced", "deleted", "failed")
SEO_PAGE_TYPES = ("story", "beat", "entity", "arc", "static")
SENTIMENT_LABELS = ("positive", "neutral", "negative")
WEBHOOK_EVENTS = (
    "story.published", "signal.detected", "entity.mentioned", "arc.updated", "saved_search.matched",
)
SIGNAL_KINDS = (
    "volume_anomaly", "sentiment_shift", "platform_divergence", "entity_surge", "emotional_register_shift",
    "key_phrase_trending", "cross_topic_correlation", "trend", "novelty", "velocity", "divergence",
)
# (tier, calls per day, calls per minute, daily cap is hard, history days kept, minimum seats); None = unlimited
TIERS = (
    ("hobbyist", 500, 60, True, 30, 1),
    ("plus", 5_000, 120, True, 30, 1),
    ("pro", 50_000, 600, False, None, 1),
    ("teams", 50_000, 600, False, None, 5),
    ("enterprise", None, None, False, None, None),
    ("internal", None, None, False, None, None),
)
TIER_DDL = (
    "tier string, per_day long, per_minute long, hard_day boolean, history_days int, seat_minimum int"
)
# (field, unit, minimum, maximum) accepted for page metadata
SEO_BOUNDS = (
    ("seo_title", "chars", 10, 45),
    ("seo_description", "chars", 50, 145),
    ("og_title", "chars", 1, 70),
    ("og_description", "chars", 1, 200),
    ("keywords", "items", 5, 10),
)
# ---- end of fixed values ------------------------------------------------------------------

TABLES = {
    "records": "id long, kind string, category string, publisher string, source_config_id int, content_type string, "
    "external_id string, content_text string, title string, url string, author string, published_at timestamp, "
    "captured_at timestamp, subreddit string, language string, source_metadata string, analysis string, "
    "sentiment_label string, sentiment_score double",
    "sources": "id int, kind string, name string, config string, enabled boolean, created_at timestamp, "
    "updated_at timestamp",
    "analysis_cursors": "task string, cursor string, updated_at timestamp",
    "embeddings": "id long, record_id long, model_name string, dimensions int, vector array<float>, "
    "created_at timestamp",
    "entities": "id int, name string, type string, first_seen timestamp, last_seen timestamp, mention_count int, "
    "indexability string, classified_at timestamp, classifier_model string, created_at timestamp, "
    "updated_at timestamp",
    "entity_mention_daily": "bucket_date date, entity_id int, mention_count int, updated_at timestamp",
    "entity_mentions": "id long, entity_id int, record_id long, start_offset int, end_offset int, "
    "confidence decimal(4,3), created_at timestamp, captured_at timestamp",
    "entity_source_counts": "entity_id int, kind string, record_count int, updated_at timestamp",
    "record_sentiment_daily": "bucket_date date, kind string, avg_score decimal(8,6), record_count int, "
    "updated_at timestamp",
    "record_source_daily": "bucket_date date, kind string, record_count int, updated_at timestamp",
    "source_kind_rollups": "kind string, total_records long, last24h_records int, last7d_records int, "
    "updated_at timestamp",
    "topic_assignments": "id long, record_id long, topic_id int, method string, confidence decimal(4,3), "
    "metadata string, created_at timestamp",
    "topic_record_counts": "topic_id int, record_count int, last_record_at timestamp, updated_at timestamp",
    "topics": "id int, name string, display_name string, description string, cluster string, "
    "keywords array<string>, active boolean, record_count int, active_story_count int, last_record_at timestamp, "
    "created_at timestamp, updated_at timestamp",
    "signal_evidence": "id long, signal_id int, target string, record_id long, entity_id int, target_topic_id int, "
    "story_id string, weight decimal(6,4), metadata string, created_at timestamp",
    "signals": "id int, kind string, topic_id int, severity string, headline string, detail string, score double, "
    "detected_at timestamp, dedup_key string, acknowledged boolean",
    "seo_metadata": "id int, page_type string, page_id string, seo_title string, seo_description string, "
    "version int, active boolean, source string, source_detail string, created_at timestamp",
    "stories": "id string, slug string, type string, topic_id int, headline string, synopsis string, "
    "key_takeaways array<string>, arc_summary string, difficulty_level string, content string, sections string, "
    "word_count int, reading_time_seconds int, faq string, schema_org string, arc_status string, "
    "generation_model string, metadata string, enriched_at timestamp, enrichment_version int, "
    "generated_at timestamp, publish_at timestamp, expires_at timestamp, active boolean, entity_name string, "
    "source_record_ids array<string>, version int, previous_version_id string, created_at timestamp, "
    "updated_at timestamp",
    "story_arc_membership": "story_id string, arc_id int, sequence_order int, added_at timestamp",
    "story_arcs": "id int, slug string, topic_id int, title string, tldr string, summary string, "
    "story_count int, first_story_at timestamp, last_story_at timestamp, generation_model string, "
    "created_at timestamp, updated_at timestamp",
    "story_citations": "id long, story_id string, marker int, citation_type string, record_id long, "
    "external_url string, domain string, fetched_at timestamp, anchor_text string, title string, excerpt string, "
    "ai_claim string, fact_type string, platform string, inferred boolean, confidence decimal(4,3), "
    "credibility_score decimal(4,3), position int, created_at timestamp",
    "story_content_variants": "id long, story_id string, variant_type string, content string, "
    "generation_model string, generated_at timestamp",
    "story_references": "id long, story_id string, ref_type string, ref_slug string, anchor_text string, "
    "target_url string, position int, created_at timestamp",
    "story_related": "id long, story_id string, related_id string, relationship_type string, ai_reason string, "
    "similarity_score decimal(4,3), computed_at timestamp",
    "search_sync_checkpoints": "kind string, last_synced_at timestamp, updated_at timestamp",
    "search_sync_projection_state": "kind string, entity_id string, chroma_id string, content_hash string, "
    "source_updated_at timestamp, last_pushed_at timestamp, last_deleted_at timestamp, status string, "
    "attempts int, last_error string, updated_at timestamp",
}

UNIQUE_KEYS = {
    "records": ("kind", "external_id"),
    "sources": ("kind", "name"),
    "embeddings": ("record_id", "model_name"),
    "entity_mention_daily": ("bucket_date", "entity_id"),
    "entity_source_counts": ("entity_id", "kind"),
    "record_sentiment_daily": ("bucket_date", "kind"),
    "record_source_daily": ("bucket_date", "kind"),
    "source_kind_rollups": ("kind",),
    "topic_assignments": ("record_id", "topic_id", "method"),
    "topic_record_counts": ("topic_id",),
    "topics": ("name",),
    "story_arc_membership": ("story_id",),
    "story_content_variants": ("story_id", "variant_type"),
    "story_references": ("story_id", "ref_type", "ref_slug"),
    "story_related": ("story_id", "related_id"),
    "search_sync_checkpoints": ("kind",),
    "search_sync_projection_state": ("kind", "entity_id"),
}

# Event streams: same field names in batch and in streaming.
STREAMS = {
    "record_ingested": "recordId string, kind string, contentType string, externalId string, capturedAt timestamp",
    "entities_extracted": "recordId string, entityCount int, extractedAt timestamp",
    "embedding_ready": "recordId string, modelName string, dimensions int",
    "topic_assigned": "recordId string, topicId int, method string, confidence double",
    "signal_detected": "signalId int, kind string, severity string, topicId int, detectedAt timestamp, "
    "evidenceTargets array<string>",
    "story_published": "storyId string, type string, topicId int, entityName string, version int, "
    "previousVersionId string, publishAt timestamp, generatedAt timestamp, generationModel string, "
    "fromEnrichment boolean",
    "story_enriched": "storyId string, enrichmentVersion int, enrichedAt timestamp, generationModel string, "
    "externalCitationCount int, variantCount int, schemaOrgGenerated boolean, arcId int",
    "arc_updated": "arcId int, arcSlug string, arcStatus string, storyCount int, updatedAt timestamp, "
    "triggerStoryId string",
    "variants_generated": "storyId string, variantTypes array<string>, generationModel string, "
    "generatedAt timestamp",
}
