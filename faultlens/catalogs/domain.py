"""Fixed domain values: languages, labels, flags and their texts.

Everything here is a constant of the problem (it decides results), so it is
stated once, plainly, and imported everywhere else.
"""

from __future__ import annotations

# File extension -> language.
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".java": "java",
    ".js": "javascript",
    ".ts": "typescript",
    ".go": "go",
    ".rb": "ruby",
    ".cs": "csharp",
    ".kt": "kotlin",
    ".swift": "swift",
}

LANGUAGES = tuple(EXTENSION_LANGUAGE.values())

# Directory names that are never analysed.
SKIP_DIRS = (
    ".git", "dist", "build", "out", "target", ".next", "__pycache__", "bundle",
    ".idea", ".vscode",
    "coverage",
    "node_modules", "vendor", ".venv", "venv", "deps",
    ".gradle", ".maven",
)

# File and repository labels in report order.
CATEGORIES = ("None", "Basic", "Mixed", "Advanced")

# The six flags of a repository row, with report headings.
CORE_FLAGS = {
    "try_catch": "Try-Catch",
    "timeout": "Timeout",
    "retry": "Retry",
    "circuit_breaker": "Circuit Breaker",
    "exponential_backoff": "Backoff",
    "status_check": "Status Check",
}

# Informational flags, counted but not part of a repository row.
EXTRA_FLAGS = (
    "promise_catch", "rate_limiting", "decorator",
    "error_check", "defer_recover",
    "rescue", "ensure",
    "do_catch", "result_type", "async_throws",
    "coroutine_timeout",
    "global_exception_handler", "exception_handler",
)

ALL_FLAGS = tuple(CORE_FLAGS) + EXTRA_FLAGS

# Native error handling of languages that do not call it try/catch.
CANONICAL_FLAG = {
    "error_check": "try_catch",
    "rescue": "try_catch",
    "do_catch": "try_catch",
}

# Text shown next to a label.
RECOMMENDATION = {
    "Mixed": "The codebase has basic and advanced exception handling.",
    "Advanced": "The codebase has advanced exception handling.",
    "Basic": "Basic exception handling detected. Consider enhancements.",
    "None": "No exception handling detected. Consider adding exception handling.",
}

# Error texts after which fetching a repository is pointless.
PERMANENT_FETCH_ERRORS = (
    "repository not found",
    "authentication failed",
    "access rights",
    "could not read from remote repository",
    "the requested url returned error: 404",
    "the requested url returned error: 403",
)

# Fixed values: (label, lowest star count) of the discovery buckets.
STAR_BUCKETS = (
    (">200", 201),
    ("51-200", 51),
    ("11-50", 11),
    ("2-10", 2),
    ("1", 1),
    ("0", 0),
)

# Language key -> display name.
LANGUAGE_DISPLAY = {
    "python": "Python",
    "java": "Java",
    "javascript": "JavaScript",
    "typescript": "TypeScript",
    "go": "Go",
    "csharp": "C#",
    "c#": "C#",
    "ruby": "Ruby",
    "kotlin": "Kotlin",
    "swift": "Swift",
    "multiple": "Multiple",
}

MULTIPLE = "Multiple"
NONE_DETECTED = "None detected"
SUBTOTAL_LABEL = "Single-Repo Total"
