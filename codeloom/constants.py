"""Names, extensions, thresholds and texts that results depend on."""

# Language by lower-cased file extension.
LANGUAGE_BY_EXTENSION = {
    ".ts": "TypeScript", ".tsx": "TypeScript",
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".py": "Python", ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".swift": "Swift",
    ".c": "C", ".cpp": "C++", ".cc": "C++", ".h": "C/C++ Header", ".hpp": "C++ Header", ".cs": "C#",
    ".rb": "Ruby", ".php": "PHP", ".sh": "Shell", ".bash": "Bash", ".zsh": "Zsh",
    ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".toml": "TOML", ".xml": "XML",
    ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".sass": "Sass", ".less": "Less",
    ".md": "Markdown", ".sql": "SQL", ".graphql": "GraphQL", ".proto": "Protocol Buffers", ".tf": "Terraform",
}

# Directory names never scanned (any name starting with "." is skipped too).
SKIPPED_DIRS = [
    "node_modules", ".git", ".repo_map", "dist", "build", "coverage", ".next", ".nuxt", "vendor",
    "__pycache__", ".pytest_cache", ".mypy_cache", "venv", ".venv", "target", "bin", "obj",
]

# Lower-cased extensions of files that are not read.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".mp4", ".mp3", ".wav", ".pdf", ".zip", ".tar",
    ".gz", ".exe", ".dll", ".so", ".dylib", ".woff", ".woff2", ".ttf", ".eot", ".lock",
]

# What a change list leaves out (a smaller set than the scan's).
CHANGE_SKIPPED_DIRS = ["node_modules", ".git", ".repo_map", "dist", "build", "coverage"]
CHANGE_SKIPPED_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".pdf", ".zip", ".tar", ".gz", ".lock", ".woff", ".woff2",
    ".ttf", ".eot",
]

# Ignore patterns that always hold, and those used when a repository brings none.
ALWAYS_IGNORED = [".git/", ".repo_map/"]
DEFAULT_IGNORED = [
    "dist/", "build/", ".next/", ".nuxt/", "out/",
    "node_modules/", "vendor/",
    "*.log", "logs/", "*.log.*",
    ".DS_Store", "Thumbs.db",
    ".vscode/", ".idea/", "*.swp", "*.swo",
    "pnpm-lock.yaml", "package-lock.json", "yarn.lock", "Cargo.lock",
    "*.min.js", "*.bundle.js", "*.map",
    "coverage/", ".nyc_output/",
    "*.tmp", "*.temp", ".cache/",
    "__pycache__/", ".pytest_cache/", ".mypy_cache/", "venv/", ".venv/",
    "target/", "bin/", "obj/",
]

# Import patterns per language, tried in this order.
IMPORT_PATTERNS = {
    "JavaScript": [
        r"""import\s+[^'"]+?\s+from\s+['"]([^'"]+)['"]""",
        r"""import\s+['"]([^'"]+)['"]""",
        r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""",
        r"""export\s+(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+['"]([^'"]+)['"]""",
    ],
    "Python": [r"from\s+([\w.]+)\s+import", r"import\s+([\w.]+)"],
    "Go": [r"""import\s+['"]([^'"]+)['"]""", r"""import\s+\w+\s+['"]([^'"]+)['"]"""],
    "Rust": [r"use\s+([\w:]+)"],
}

# Code extensions stripped from import targets, in this order.
STRIPPED_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java"]

# Extensions that make a file of more than 100 lines complex.
COMPLEX_EXTENSIONS = ["ts", "tsx", "js", "jsx", "py", "go", "rs", "java"]
# Substrings of lower-cased paths that mark configuration and test files.
CONFIG_OR_TEST_MARKS = ["config", "test", ".json", ".yaml", ".yml", ".md", ".env"]
# Substrings that mark test files (case-sensitive).
TEST_MARKS = ["test", "spec", "__tests__"]

# Scoring.
POINTS_PER_IMPORTER = 5
POINTS_PER_IMPORT = 2
POINTS_PER_EXPORT = 3
LARGE_FILE_LINES = 1000
LARGE_FILE_PENALTY = 5

# Limits of reports and prompts.
MAX_FILES_PER_SECTION = 10
MAX_EXPORTS_PER_FILE = 5
MAX_CONVENTIONS = 5
MAX_FILES_IN_PROMPT = 10
MAX_PROMPT_LINES = 10000
HEAD_RATIO = 0.7
MAX_PURPOSE_CHARS = 200

# Packing by lines of code.
TARGET_LOC = 500
LOC_CAP = 500
LARGE_LOC = 300
COMPLEX_LOC = 100
MAX_FILES_PER_TASK = 50

# Change thresholds.
VALIDATE_FROM_CHANGES = 20
REBUILD_ABOVE_CHANGES = 100

# Plan rules.
MAX_DEVIATION_PERCENT = 15
MAX_MINUTES_PER_FILE = 5
IMBALANCE_HIGH = 1.5
IMBALANCE_LOW = 0.5
MIN_TASK_COUNT = 3
LARGE_REPO_FILES = 100
SMALL_AGENT_FILES = 50

# Request and input-token limits per rolling minute.
REQUESTS_PER_MINUTE = 50
TOKENS_PER_MINUTE = 8000

# USD per million tokens (input, output) by model.
MODEL_PRICES = {
    "claude-haiku-4-5-20251001": (0.25, 1.25),
    "claude-sonnet-4-5-20250929": (3.0, 15.0),
}
# Level names.
LEVEL_NAMES = {1: "Detection", 2: "Division", 3: "Annotation"}
