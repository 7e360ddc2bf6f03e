"""Canonical feedback columns, the header names they are recognised by, and missing-value spellings."""

# Canonical field -> recognised header names, in order of preference.
ALIASES = {
    "review_text": ("review_text", "review", "text", "feedback", "content", "comment", "message", "review_body"),
    "review_id": ("review_id", "reviewid", "id", "feedback_id"),
    "date": ("date", "created_at", "timestamp", "time", "at", "submitted_at"),
    "rating": ("rating", "score", "stars", "star_rating"),
    "platform": ("platform", "source", "channel", "os"),
    "app_version": ("app_version", "version", "appversion"),
    "country": ("country", "region", "location", "city"),
    "device": ("device", "device_type", "handset"),
    "user_segment": ("user_segment", "segment", "customer_segment", "user_type"),
}
OPTIONAL = tuple(f for f in ALIASES if f != "review_text")
CATEGORICAL = ("platform", "app_version", "country", "device", "user_segment")
CLEAN_COLUMNS = (
    "review_id", "original_text", "clean_text", "date", "rating", "platform", "app_version", "country", "device",
    "user_segment", "source_row_number",
)
FILTERABLE = (
    "platform", "rating", "country", "device", "app_version", "primary_theme", "sentiment", "user_segment",
)

# Cell spellings that CSV readers commonly treat as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
