"""Fixed values and job parameters.

Values under "fixed values" must equal the behaviour being reproduced (label codes, thresholds,
model names and sets, keyword lists).  Values under "job parameters" are ours: they steer the
jobs over the driver's test tables.
"""

from __future__ import annotations

import datetime as _dt

# ---------------------------------------------------------------------------------------------
# fixed values
# ---------------------------------------------------------------------------------------------

# sentiment label codes: 0 negative, 1 neutral, 2 positive
LABEL_NAMES = {0: "negative", 1: "neutral", 2: "positive"}
LABEL_COLORS = {"positive": "green", "neutral": "gray", "negative": "red"}
NEUTRAL = 1

# eligibility / cleaning thresholds
MIN_TEXT_LENGTH = 30
MAX_TEXT_LENGTH = 4096
MIN_CONFIDENCE = 0.2
EXCLUDE_KEYWORDS = ["광고", "홍보", "sponsored"]
MIN_CONTENT_WORDS = 3
MIN_SENTIMENT_WORDS = 2
MAX_TOKENS = 512
SCORER_TEXT_CAP = 2048
LOW_CONFIDENCE_FALLBACK = 0.1

# comment override of a post label
COMMENT_MIN_COUNT = 5
COMMENT_MIN_SHARE = 0.6

# snippet window and excerpt length
SNIPPET_RADIUS = 50
EXCERPT_LENGTH = 100
FIXED_CHUNK_SIZE = 5000
TOP_CONFIDENCE_ROWS = 500
TOP_PER_LABEL = 5
RECENT_DEFAULT_N = 10
REPORT_SAMPLE_N = 10

# ensemble members, in their fixed order, and the named sets
MODEL_NAMES = ["kobert", "kcelectra-base-v2022", "kcelectra", "kcbert-large", "kosentencebert"]
MODEL_SETS = {
    "light": ["kobert", "kcelectra-base-v2022"],
    "balanced": ["kcelectra-base-v2022", "kcelectra", "kosentencebert"],
    "heavy": ["kcbert-large", "kosentencebert", "kcelectra-base-v2022"],
    "custom": [],
}
DEFAULT_FALLBACK_MODELS = ["kobert", "kcelectra-base-v2022", "kcelectra"]

# platforms and the names that roll up to them; other naver_ names roll up to naver, the rest is rejected
PLATFORM_PARENTS = ["naver", "youtube", "google", "buan_gov", "community"]
PLATFORM_ALIASES = {
    "naver_blog": "naver", "naver_blog_api": "naver", "naver_cafe": "naver", "naver_cafearticle": "naver",
    "naver_cafearticle_api": "naver", "naver_news": "naver", "naver_community": "naver",
    "youtube_api": "youtube",
    "google_search": "google", "google_news": "google",
    "buan_gov_news": "buan_gov", "buan_gov_notice": "buan_gov",
    "local_community": "community", "tour_community": "community",
}

# platform names that validation accepts, and the columns it requires
REQUIRED_COMMON = ["title", "content", "published_date", "platform", "url"]
VALID_PLATFORMS = PLATFORM_PARENTS + list(PLATFORM_ALIASES)
VIDEO_PLATFORMS = ["youtube", "youtube_api"]            # these also require video_id

# period units chosen from the span of dates (days): > 3650 Y, > 1825 3M, > 180 M, > 30 W, else D
PERIOD_UNIT_STEPS = [(3650, "Y"), (1825, "3M"), (180, "M"), (30, "W")]

# HTML entities replaced after tags are stripped, in this order
HTML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')]

# emoji / pictograph ranges removed from titles (our list)
EMOJI_CLASS = (
    "[\\x{1F300}-\\x{1FAFF}\\x{1F000}-\\x{1F2FF}\\x{2600}-\\x{27BF}"
    "\\x{FE0F}\\x{200D}\\x{2B00}-\\x{2BFF}\\x{1F1E6}-\\x{1F1FF}]"
)

# ---------------------------------------------------------------------------------------------
# job parameters (ours)
# ---------------------------------------------------------------------------------------------

# "today" for every date rule; the reference uses the wall clock
AS_OF = _dt.date(2024, 6, 1)

# region keywords; frequent latin words of the test corpus stand in for place names
REGION_KEYWORDS = ["the", "der", "que", "les"]

# web-search API quota per day; variants are capped at max(1, quota // 10) (10 results a page)
SEARCH_DAILY_QUOTA = 100

# keyword objects {text, condition}; element 0 is the region keyword
KEYWORD_SPEC = [("the", "AND"), ("and", "AND"), ("of", "OR"), ("with", "OR"), ("der", "OR")]

# required / excluded keyword lists of the post-processing filter
REQUIRED_KEYWORDS = ["the", "der", "que", "les", "und"]
EXCLUDED_KEYWORDS = ["sponsored", "nicht"]

# rule scorer lexicon (our own, used by the native scorer)
POSITIVE_WORDS = ["and", "und", "et", "y", "with", "mit", "avec", "con", "good", "best"]
NEGATIVE_WORDS = ["not", "nicht", "pas", "no", "ne", "sin", "sans", "ohne", "bad", "error"]
RULE_SCORE_SCALE = 30.0

# the ensemble members as native scorers: each weighs the English/German and the French/Spanish
# words of the lexicon its own way -> (scale, weight of the first, weight of the second)
GERMANIC_WORDS = ["and", "und", "with", "mit", "good", "best", "not", "nicht", "ohne", "bad", "error"]
MODEL_RULES = {
    "kobert": (30.0, 1.0, 1.0),
    "kcelectra-base-v2022": (30.0, 1.0, 0.5),
    "kcelectra": (30.0, 0.5, 1.0),
    "kcbert-large": (20.0, 1.0, 1.0),
    "kosentencebert": (45.0, 1.0, 1.0),
}
