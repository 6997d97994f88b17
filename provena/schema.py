"""Table schemas and fixed values of the provenance graph."""

from __future__ import annotations

DOCUMENTS = "src_ord int, rel_path string, path string, mtime double, text string"
NODES = "id string, label string, kind string, source_file string, source_location int"
LINKS = "source string, target string, relation string"
SUPPRESSIONS = "name string, signature string"

# File name endings that are read.
MARKDOWN_SUFFIXES = (".md", ".markdown")
HTML_SUFFIXES = (".html", ".htm")

# Korean relation words and the relation each one means.
KOREAN_RELATIONS = {
    "대체함": "supersedes",
    "대체": "supersedes",
    "부분대체함": "supersedes_partially",
    "부분대체": "supersedes_partially",
    "관련": "relates_to",
    "관련됨": "relates_to",
    "참고": "relates_to",
    "후속": "follows",
    "따름": "follows",
    "선행": "precedes",
    "정정함": "corrects",
    "정정": "corrects",
    "포함": "part_of",
    "속함": "part_of",
    "확장": "extends",
    "구현": "implements",
    "반박": "contradicts",
    "출처": "sources",
    "근거": "sources",
}

# HTML tags that carry headings and text, and those whose content is dropped.
HEADING_TAGS = ("h1", "h2", "h3")
TEXT_TAGS = ("p", "li", "td", "th", "text", "title")
DROP_TAGS = ("style", "script")

# Names watched by default, the reach of a watched name, and what breaks it.
WATCHED_NAMES = ("bend radius", "tray width", "tray thickness", "tier gap", "lane gap", "clearance", "edge clearance")
WATCH_WINDOW, UNIT_TAIL = 18, 4
WATCH_BREAKERS = ("+", "-", "±", "x ", "×", "plus", "over", "than", "gap")

# Units, each with its base unit and scale.
UNITS = ("mm", "cm", "km", "m", "s", "ms", "%", "MB", "KB", "GB")
UNIT_SCALE = {"mm": ("m", 0.001), "cm": ("m", 0.01), "m": ("m", 1.0), "km": ("m", 1000.0), "ms": ("s", 0.001), "s": ("s", 1.0)}

# Patterns of numbers, of what may stand beside them, and of names.
NUMBER = r"-?\p{Nd}{1,3}(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?|-?\p{Nd}+(?:\.\p{Nd}+)?"
NUMBER_BEFORE, UNIT_AFTER = r"(?<![\p{Nd}.\-–])", r"(?![A-Za-z0-9])"
PAIR_NAME, PAIR_NUMBER = r"[A-Za-z가-힣][A-Za-z0-9 _\-/()가-힣]{1,38}?", r"-?\p{Nd}+(?:\.\p{Nd}+)?"
NAME_WORD = r"[A-Za-z가-힣][A-Za-z0-9_\-가-힣]*"

# Words that name no value, and words a name cannot end in.
GENERIC_NAMES = ("observations", "relations", "context", "decision", "consequences", "note", "notes", "summary", "status")
STOP_TAILS = ("to", "is", "are", "was", "were", "up", "at", "of", "in", "on", "by", "for", "from", "than", "about", "roughly", "under", "over", "with", "and", "or", "the", "a", "an", "reach", "captures", "design", "measured", "found", "gives")
CONTEXT_PREFIX, CONTEXT_WORDS, NAME_WORDS, NAME_LENGTH = 60, 4, 3, 4

# Relations that are causes, relations near to them, and how far chains go.
CAUSE_RELATIONS = ("caused_by", "caused", "causes", "led_to")
NEARBY_RELATIONS = ("supersedes", "supersedes_partially", "corrects", "refines", "extends", "follows", "continues", "operationalizes")
CHAIN_DEPTH, CHAIN_ROWS = 3, 20

# Pages, samples, hints and the answer budget.
CONFLICT_PAGE, PREVIEW = 10, 150
SAMPLES = 5
LOCATED_LEAST, DOCUMENT_MOST, KINDS_LEAST, NODES_PER_COMPONENT = 0.8, 0.5, 2, 50
ANSWER_BUDGET, NAMED_DOCUMENTS = 20000, 4
