"""Fixed values of the corpus model: kinds, language maps, skip lists, noise names.

Everything here is a small constant (well under 200 entries per table), used as
map literals or ``isin`` lists, so no join and no broadcast is needed for it.
"""

from __future__ import annotations

# --- fixed values: file extension -> language (case-sensitive) ---------------
EXTENSION_LANGUAGE = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".rs": "rust", ".rb": "ruby",
    ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp",
    ".cls": "apex", ".trigger": "apex", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin",
    ".lua": "lua", ".php": "php", ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".zig": "zig", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
    ".md": "markdown", ".sql": "sql", ".proto": "protobuf", ".tf": "hcl", ".hcl": "hcl",
    ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hs": "haskell", ".ml": "ocaml",
    ".mli": "ocaml", ".scala": "scala", ".r": "r", ".R": "r", ".pl": "perl", ".pm": "perl",
    ".dart": "dart", ".vue": "vue", ".svelte": "svelte",
}

# --- fixed values: special file names -> language ----------------------------
FILENAME_LANGUAGE = {
    "Makefile": "make", "makefile": "make", "GNUmakefile": "make",
    "Dockerfile": "dockerfile", "Jenkinsfile": "groovy", "CMakeLists.txt": "cmake",
}

# --- fixed values: languages the extraction job understands ------------------
SUPPORTED_LANGUAGES = (
    "apex", "bash", "c", "cpp", "csharp", "dart", "elixir", "go", "hcl", "java", "javascript",
    "kotlin", "lua", "php", "protobuf", "python", "ruby", "rust", "scala", "swift", "typescript",
    "yaml",
)

# --- fixed values: directory names that are never entered --------------------
SKIP_DIRECTORIES = (
    ".git", ".idea", ".mypy_cache", ".next", ".nuxt", ".tox", ".venv", ".vscode", "__pycache__",
    "build", "dist", "node_modules", "target", "vendor", "venv",
)

# --- fixed values: the two sets of "type kinds" ------------------------------
TYPE_KINDS = ("class", "enum", "extension", "interface", "mixin", "object", "struct", "trait", "type")
TYPE_REF_KINDS = ("class", "enum", "interface", "struct", "trait", "type")
CALLABLE_KINDS = ("function", "method")

# --- fixed values: rank of a kind; every kind not named here ranks 0 ---------
KIND_PRIORITY = {
    "struct": 0, "class": 0, "interface": 0, "type": 0,
    "function": 1, "method": 2, "enum": 3, "variable": 4,
}

# --- fixed values: callee names a downward trace leaves out ------------------
TRACE_NOISE = (
    "append", "bool", "byte", "cap", "close", "copy", "delete", "error", "float32", "float64",
    "int", "int16", "int32", "int64", "int8", "len", "make", "new", "nil", "panic", "recover",
    "rune", "string", "uint", "uint16", "uint32", "uint64", "uint8",
    "Abs", "Add", "Base", "Begin", "Close", "Commit", "Contains", "Create", "Dir", "Done", "Error",
    "Errorf", "Exec", "Ext", "Fprintf", "Go", "HasPrefix", "HasSuffix", "Join", "Load", "Lock",
    "Lstat", "Next", "Now", "Open", "Printf", "Println", "Query", "QueryRow", "RLock", "RUnlock",
    "Read", "ReadFile", "Rel", "Remove", "Rollback", "Rows", "Scan", "Since", "Sleep", "Split",
    "Sprintf", "Stat", "Store", "String", "TrimPrefix", "TrimSuffix", "Unlock", "Wait", "Write",
    "WriteFile",
)
TRACE_MIN_NAME_BYTES = 3

# --- fixed values: defaults and clamps of the query surface ------------------
LIMIT_SEARCH = 50
LIMIT_REFS = 50
LIMIT_TEXT = 50
LIMIT_IMPORTERS = 50
LIMIT_TRACE = 50
LIMIT_IMPACT = 100
LIMIT_STRUCTURE = 10
LIMIT_BUNDLE_REFS = 20
LIMIT_BUNDLE_IMPACT = 20
LIMIT_BUNDLE_MEMBERS = 50
LIMIT_RESOLVE_EXACT = 100
LIMIT_RESOLVE_FUZZY = 20
MAX_TYPE_LINES = 60
SNIPPET_CHARS = 200
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6


def clamp_depth(depth: int, default: int, maximum: int) -> int:
    """Zero or negative depth means the default; larger ones are cut to the maximum."""
    return default if depth <= 0 else min(depth, maximum)
