"""Word lists, thresholds, alias and rule tables that results depend on."""

from __future__ import annotations

from typing import NamedTuple

TICKERS = ("TSLA", "NVDA", "AMD", "AAPL", "META")

# Lexicon terms.
POSITIVE = (
    "beat", "beats", "bullish", "gain", "gains", "growth", "jump", "jumps", "outperform", "profit",
    "rally", "record", "rise", "rises", "strong", "surge", "surges", "upgrade", "upside",
)
NEGATIVE = (
    "bearish", "cut", "decline", "declines", "downgrade", "drop", "drops", "fall", "falls", "loss",
    "miss", "misses", "recall", "risk", "selloff", "slump", "weak", "warning",
)

# Calibration of lexicon scores.
GAP = 0.12
SHORT_WORDS = 12
SHORT_CAP = 0.76
LONG_CAP = 0.82
NEUTRAL_FLOOR = 0.30
TICKER_BAND = 0.05
# how a rule scales both directions and what it adds to neutral: close directions, no term found, a short text of one term
CLOSE, UNFOUNDED, BRIEF = (0.95, 0.10), (0.92, 0.12), (1.0, 0.08)

# Calibration of the direction signal.
PROBABILITY_RANGE = (0.18, 0.82)
CONFIDENCE_RANGE = (0.52, 0.78)
UP, DOWN = 0.52, 0.48
# the model's share and that of the prior, the prior's slope and its weights of sentiment and price
MODEL_SHARE, PRIOR_SHARE = 0.6, 0.4
PRIOR_SLOPE, PRIOR_SENTIMENT, PRIOR_PRICE = 8, 0.35, 1.5
# what price, sentiment and volume may add to confidence: weight and most
CONFIDENCE_PRICE, CONFIDENCE_SENTIMENT, CONFIDENCE_VOLUME = (2, 0.04), (0.06, 0.04), (0.02, 0.02)
REQUEST_PRICE, REQUEST_VOLUME = 0.08, 0.5

# Texts and sources that are no posts.
PLACEHOLDERS = ("sample post while waiting for api approval", "sample fallback post", "discussion about")
SOCIAL_SOURCES = ("reddit", "twitter", "x.com", "stocktwits", "discord", "telegram")


class Alias(NamedTuple):
    ticker: str
    cashtag: str
    company: str
    strong: tuple[str, ...]
    contextual: tuple[str, ...]
    context: tuple[str, ...]
    exclusions: tuple[str, ...]


# Ticker aliases.
ALIASES = (
    Alias(
        "TSLA", "$TSLA", "Tesla, Inc.",
        ("Tesla Inc", "Tesla Motors", "Tesla Energy", "Tesla Semi", "Cybertruck", "Gigafactory"),
        ("Tesla",),
        ("Tesla Inc", "Tesla Motors", "Tesla Energy", "Tesla Semi", "Cybertruck", "Gigafactory", "automaker", "electric vehicle", "EV", "earnings", "revenue", "shares", "stock"),
        ("Nikola Tesla", "Tesla coil", "Tesla unit", "Tesla Science Center"),
    ),
    Alias(
        "NVDA", "$NVDA", "NVIDIA Corporation",
        ("NVIDIA", "Nvidia Corporation", "GeForce", "CUDA", "DGX", "Blackwell GPU", "H100", "H200", "B200"),
        (), (), (),
    ),
    Alias(
        "AMD", "$AMD", "Advanced Micro Devices, Inc.",
        ("Advanced Micro Devices", "AMD Inc", "AMD Ryzen", "AMD Radeon", "AMD EPYC", "Ryzen", "Radeon", "EPYC", "earnings", "stock", "shares"),
        ("AMD",),
        ("Advanced Micro Devices", "semiconductor", "chip", "chips", "processor", "CPU", "GPU", "data center", "Ryzen", "Radeon", "EPYC"),
        ("age-related macular degeneration", "advanced manufacturing district", "automated market data"),
    ),
    Alias(
        "AAPL", "$AAPL", "Apple Inc.",
        ("Apple Inc", "Apple Computer", "iPhone", "iPad", "MacBook", "Apple Watch", "App Store", "Apple Intelligence", "Cupertino-based Apple"),
        ("Apple",),
        ("Apple Inc", "iPhone", "iPad", "Mac", "MacBook", "iOS", "App Store", "Tim Cook", "Cupertino"),
        ("apple pie", "apple recipe", "apple orchard", "apple harvest", "apple cider", "Apple Records"),
    ),
    Alias(
        "META", "$META", "Meta Platforms, Inc.",
        ("Meta Platforms", "Meta Platforms Inc", "Facebook", "Instagram", "WhatsApp", "Reality Labs", "Meta Quest", "Facebook parent Meta"),
        ("Meta",),
        ("Meta Platforms", "Facebook", "Instagram", "WhatsApp", "Reality Labs", "Quest headset", "Mark Zuckerberg", "earnings", "stock", "shares"),
        ("meta-analysis", "metadata", "metaverse", "meta tag", "Meta Quest competitor"),
    ),
)

# Patterns that generated copy may not hold (category, kind, pattern).
RULES = (
    ("causal_price", "literal", "the stock fell because"),
    ("causal_price", "literal", "the stock rose because"),
    ("causal_price", "literal", "this move was driven by"),
    ("causal_price", "literal", "explains today's decline"),
    ("causal_price", "regex", r"\b(?:the\s+)?stock\s+(?:fell|rose|dropped|gained)\s+because\b"),
    ("causal_price", "regex", r"\b(?:this|today'?s)\s+(?:move|decline|drop|rise|rally)\s+(?:was|is)\s+(?:driven|caused)\s+by\b"),
    ("causal_price", "regex", r"\bexplains?\s+(?:today'?s\s+)?(?:decline|drop|rise|rally)\b"),
    ("prediction", "literal", "will rise"),
    ("prediction", "literal", "will fall"),
    ("prediction", "literal", "expected to rise"),
    ("prediction", "literal", "expected to fall"),
    ("prediction", "regex", r"\b(?:is|are)\s+expected\s+to\s+(?:rise|fall|increase|decrease)\b"),
    ("prediction", "regex", r"\b(?:will|going\s+to)\s+(?:rise|fall|rally|decline)\b"),
    ("prediction", "regex", r"\bshares?\s+will\s+(?:be\s+)?(?:higher|lower|rise|fall|rally|decline)\b"),
    ("prediction", "regex", r"\bshares?\s+will\s+move\s+(?:higher|lower)\b"),
    ("prediction", "regex", r"\b(?:the\s+)?stock\s+is\s+going\s+to\s+(?:rally|decline|rise|fall)\b"),
    ("advisory", "regex", r"\b(?:Tesla|NVIDIA|Apple|Meta|AMD|TSLA|NVDA|AAPL|META|the\s+(?:stock|company)|this\s+stock|shares?)\s+(?:is|are|looks?\s+like)\s+(?:a\s+)?(?:strong\s+)?buy\b"),
    ("advisory", "regex", r"\b(?:we|you|investors?)\s+(?:should|must|recommend(?:\s+that)?|advise(?:\s+to)?)\s+(?:buy|sell|hold|buying|selling|holding)\b"),
    ("advisory", "regex", r"\bthis\s+is\s+a\s+strong\s+buy\s+(?:opportunity|recommendation)\b"),
    ("advisory", "regex", r"\b(?:buy|sell|hold)\s+(?:shares?\s+of\s+)?(?:TSLA|NVDA|AMD|AAPL|META|Tesla|NVIDIA|Apple|Meta)\b"),
    ("advisory", "regex", r"\b(?:buy|sell|hold)\s+(?:the\s+)?(?:stock|shares?)\b"),
    ("advisory", "regex", r"\b(?:the\s+)?price\s+target\s+implies\s+(?:the\s+)?(?:stock|shares?)\s+(?:will|should)\s+(?:rise|fall|increase|decrease)\b"),
    ("unsupported_certainty", "regex", r"\b(?:will|is)\s+(?:certain|guaranteed)\s+to\b"),
    ("unsupported_certainty", "regex", r"\b(?:definitively|certainly)\s+(?:explains|proves|will)\b"),
    ("model_confidence", "literal", "confidence score"),
    ("model_confidence", "literal", "probability of moving"),
    ("model_confidence", "regex", r"\b(?:model|prediction)\s+confidence\b"),
    ("model_confidence", "regex", r"\bprobability\s+of\s+(?:moving|rising|falling)\b"),
    ("model_confidence", "regex", r"\b\d{1,3}%\s+(?:probability|chance)\s+(?:of\s+)?(?:a\s+)?(?:move|rise|fall)\b"),
)
CATEGORIES = ("causal_price", "prediction", "advisory", "unsupported_certainty", "model_confidence")
GENERATED_SCOPES = ("generated_summary", "generated_label", "product_ui_copy")
RAW_SCOPES = ("publisher_headline", "publisher_description", "publisher_quotation")

#: Words of other companies' news that the strict aliases leave out of the names of one.
GENERIC = ("earnings", "stock", "shares")
STRICT_ALIASES = tuple(a._replace(strong=tuple(t for t in a.strong if t not in GENERIC)) for a in ALIASES)
