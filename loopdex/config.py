"""Configuration and the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
# CDN hosts rewritten to the canonical host, applied in this order.
CDN_HOSTS_OLD = ("38.media.tumblr.com", "33.media.tumblr.com", "31.media.tumblr.com")
CDN_HOST_NEW = "64.media.tumblr.com"
# Media id pattern inside a URL.
MEDIA_ID_PATTERN = "tumblr_([a-zA-Z0-9]+)"
# Prefix of hashed document ids.
DOC_ID_PREFIX = "gif_"
# Phrase marking removed content (matched case-insensitively).
REMOVED_PHRASE = "content has been removed"
# Redirect path that marks a media violation on fetch.
VIOLATION_PATH = "media_violation"
# Tags hidden from every user (the reference's set).
DEFAULT_BLOCKED_TAGS = ("porn",)
# Labels printed by the flattened search text.
COMBINED_LABELS = ("Source: ", "Mood: ", "Actions: ", "Use case: ", "Tags: ")
# Frames sampled per item and largest frame side in pixels.
FRAMES_PER_ITEM = 5
MAX_FRAME_SIDE = 512
# Video formats sampled by timestamp; anything else is sampled by frame index.
VIDEO_FORMATS = ("mp4", "webm")
DEFAULT_MEDIA_FORMAT = "gif"
# Cost model per described item: input tokens, input $/M, output tokens, output $/M.
COST_INPUT_TOKENS = 1500
COST_INPUT_PER_M = 0.08
COST_OUTPUT_TOKENS = 150
COST_OUTPUT_PER_M = 0.30
# Search and sampling defaults.
DEFAULT_SEARCH_LIMIT = 50
APP_SEARCH_LIMIT = 20
DEFAULT_SAMPLE_LIMIT = 30
SAMPLE_MAX_WINDOWS = 5
# Debounce quiet time for keystroke streams, in milliseconds.
DEBOUNCE_MS = 300
# Vector dimensions of the image and the text index.
IMAGE_DIM = 512
TEXT_DIM = 384
# Ingest batch sizes: vector ingest, text ingest.
VECTOR_BATCH = 10
TEXT_BATCH = 50
# Detail view: fields never shown, field order, and display labels.
DETAIL_HIDDEN_FIELDS = ("id", "gif_url", "score", "rank", "combined_text", "_embeddings", "attribution")
DETAIL_AI_FIELDS = ("tags", "literal", "source", "mood", "action", "context")
DETAIL_ORIGINAL_FIELDS = ("original_description", "description", "tumblr_id")
DETAIL_LABELS = {
    "tags": "Tags",
    "literal": "Description",
    "source": "Source",
    "mood": "Mood",
    "action": "Actions",
    "context": "Use Case",
    "original_description": "Original Caption",
    "description": "Original Caption",
    "tumblr_id": "Tumblr ID",
    "_timestamp": "Retrieved At",
    "timestamp": "Retrieved At",
    "created_at": "Retrieved At",
}
DETAIL_TIMESTAMP_KEYS = ("_timestamp", "timestamp", "created_at")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class SearchConfig:
    """Parameters of ranking that the reference leaves to its search server.

    BM25 (k1, b) and reciprocal-rank fusion (rrf_k) follow the published defaults
    (Robertson & Zaragoza 2009; Cormack, Clarke & Buettcher 2009).
    """

    k1: float = 1.2
    b: float = 0.75
    rrf_k: int = 60
    limit: int = DEFAULT_SEARCH_LIMIT
    depth: int | None = None  # candidate depth per list; None = limit
    blocked_tags: tuple[str, ...] = DEFAULT_BLOCKED_TAGS
    token_pattern: str = "[\\p{L}\\p{N}]+"

    @property
    def list_depth(self) -> int:
        return self.depth if self.depth is not None else self.limit
