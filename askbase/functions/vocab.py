"""Fixed values that decide results: header words, phrases, markers."""

# Column headers that name a role on their own.
QUESTION_HEADERS = (
    "ask", "item", "q", "query", "question", "questions",
    "rfi question", "rfi questions", "topic question",
)
ANSWER_HEADERS = (
    "a", "answer", "answers", "our answer", "our response",
    "replies", "reply", "response", "responses",
)
CONTEXT_HEADERS = (
    "background", "comment", "comments", "context", "details",
    "evidence", "note", "notes", "supporting evidence",
)
METADATA_HEADERS = {
    "#": "ref", "id": "ref", "no": "ref", "no.": "ref", "number": "ref",
    "ref": "ref", "reference": "ref",
    "area": "category", "category": "category", "domain": "category",
    "section": "category", "tag": "category", "tags": "category",
    "topic": "category", "type": "category",
    "client": "client_internal_ref", "client ref": "client_internal_ref",
    "sub-category": "subcategory", "subcategory": "subcategory",
}

# Roles with a meaning of their own, and the rule for others.
RESERVED_ROLES = ("question", "answer", "context", "ignore")
ROLE_NAME = "^[a-z][a-z0-9_]*$"

# What a refused answer says.
REFUSAL_TEXT = "I cannot find this in our corpus."
REFUSAL_PHRASE = "cannot find this in our corpus"
ANSWER_MISSING = "(answer not found)"

# Words that start a list item, words that name a bold font.
LIST_MARKER = r"^(?:[•●▪◦‣■□◆]|\d+[.)]|-|\*)$"
BOLD_FONT = "(?i)bold|black|heavy|semibold|demi"

# Window sizes and scoring constants.
PROFILE_ROWS = 200
HEADER_SCAN_ROWS = 50
RRF_K = 60
POOL_SIZE = 20
TOP_K = 3
EMBED_BATCH = 16
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# Strategy and distance of the four logical collections.
COLLECTIONS = {
    "combined_cosine": ("combined", "cosine"),
    "combined_l2": ("combined", "l2"),
    "separated_cosine": ("separated", "cosine"),
    "separated_l2": ("separated", "l2"),
}
RETRIEVAL_MODES = ("semantic", "bm25", "hybrid")
RERANK_MODES = ("none", "crossencoder", "llm")
