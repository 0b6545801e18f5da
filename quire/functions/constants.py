"""Values that the formats and rules fix."""

# White space and line ends as the text rules see them, for Java's and RE2's patterns alike.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

UNKNOWN = "[UNKNOWN]"
NO_TEXT = "[NO TEXT FOUND]"
FALLBACK_CATEGORY, FALLBACK_GROUNDING = "CONTEXT", "uncertain"

# Categories and groundings.
CATEGORIES = ["CONCEPT", "METHOD", "RESULT", "EVIDENCE", "DEFINITION", "INTERPRETATION", "LIMITATION", "ASSUMPTION", "IMPORTANT", "QUESTION", "CONTEXT", "TECHNICAL"]
GROUNDINGS = ["source_fact", "interpretation", "uncertain"]

# Section names of articles, front matter marks, empty phrases.
SECTION_NAMES = [
    "abstract", "introduction", "background", "related work", "literature review", "methods", "methodology", "materials and methods", "experimental setup",
    "results", "results and discussion", "discussion", "conclusion", "conclusions", "limitations", "references", "acknowledgments", "acknowledgements",
]
FRONT_MATTER = ["all rights reserved", "copyright", "published by", "isbn", "library of congress", "first edition", "table of contents", "contents"]
GENERIC_PREFIXES = ["this passage discusses", "this passage shows", "this shows that", "this is important because", "this is significant because"]

# Typographic signs and what they are searched as.
SUBSTITUTIONS = [("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"), (" ", " "), ("ﬁ", "fi"), ("ﬂ", "fl")]

# Fields of an answer and of its rows.
TOP_FIELDS = ["chapter_number", "chapter_title", "start_page", "end_page", "annotations"]
ROW_FIELDS = ["page", "book_text", "annotation", "category", "grounding"]

# Small letters that Unicode's case folding takes for others.
FOLDED = [("ς", "σ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ſ", "s"), ("ŉ", "ʼn")]

# Formats, rates and limits.
EXTENSIONS = [".pdf", ".epub", ".mobi", ".txt", ".azw", ".azw3"]
QUALITY_FACTORS = {"low": 0.85, "medium": 1.0, "high": 1.35}
OUTPUT_TOKENS_LOW, OUTPUT_TOKENS_HIGH = 110, 280
INPUT_RATE, OUTPUT_RATE, BUDGET_WARNING = 0.40, 1.20, 0.75
MAX_CONTEXT, CHUNK_OUTPUT, TOKENS_PER_NOTE, DENSE_CHUNK_PAGES = 1_050_000, 100_000, 220, 20
FRAME_TOKENS, FRAME_PAGES = 1500, 8
HEADER_RATIO, HEADER_LINES = 0.30, 2
FRONT_PAGES, FRONT_WORDS = 25, 150
SHORT_NOTE_WORDS, LONG_NOTE_WORDS = 3, 140
SKIP_QUALITY_PAGES, DENSE_HIGH_QPP, RETRIES = 100, 3, 3

CSV_COLUMNS = ["document", "chapter", "chapter_title", "page", "category", "grounding", "source_text", "annotation", "quality", "density"]
