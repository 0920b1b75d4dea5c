"""The words, markers and patterns that decide what a log line means.

Results depend on these exact values, so they stand here as plain text.  The
patterns use only what Java, RE2 and Python share; ``BLANK`` stands for the
Unicode blanks because ``\\s`` means something different in each of them.
"""

# --- fixed values: characters -------------------------------------------------
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK_RANGES = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANK = f"[{BLANK_RANGES}]"
NOT_BLANK = f"[^{BLANK_RANGES}]"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]"

# --- fixed values: line cleaning ----------------------------------------------
ANSI_COLOUR = r"\x1b\[[0-9;]*m"
ECHO_PREFIX = r"^\+ echo "
ECHO_START = "+ echo"

# --- fixed values: `standard` line rules (case-insensitive unless said) -------
GIT_NOTE = rf">{BLANK}*git{BLANK}+.*#{BLANK}*timeout="  # case-sensitive
GIT_COMMAND = rf"^{BLANK}*>{BLANK}+git{BLANK}+"  # case-sensitive
STANDARD_ERROR = (
    r"\[ERROR\]|\bERROR\b|\bFAILED\b|\bFAILURE\b|compilation failed|test.*failed"
    rf"|dependency.*error|\btimeout{BLANK}+(?:error|exceeded)|exception"
)
STANDARD_WARNING = r"\[WARNING\]|\bWARNING\b|\bWARN\b|deprecated|unstable|flaky"
STANDARD_RETRY = r"\bretry|\bretried|re-try|try again|attempting again"
# Lower-case pieces without which the pattern cannot match; they spare most lines the
# pattern.  None has an i, s or k: letters beyond ASCII match those in any case.
STANDARD_ERROR_HINTS = ("error", "fa", "except", "meout")
STANDARD_WARNING_HINTS = ("warn", "deprecated", "table", "fla")
STANDARD_RETRY_HINTS = ("retr", "re-try", "try aga", "attempt")

# --- fixed values: `legacy` line rules (case-insensitive unless said) ---------
LEGACY_ERROR = (
    r"\[ERROR\]|\bFAILED\b|\bFAILURE\b|compilation failed|dependency|timeout|deployment failed"
    r"|unit test failed|db connection timeout|critical error|2 critical errors"
)
LEGACY_WARNING = (
    r"\[WARNING\]|warning:|deprecated|flaky|slow response|large package|unstable|disk space"
    r"|health check|certificate|rate limit"
)
LEGACY_RETRY = r"retry|retried|re-try|try again|flaky"
LEGACY_CRITICAL = "critical"
LEGACY_ERROR_HINTS = ("error", "fa", "dependency", "meout")
LEGACY_WARNING_HINTS = (
    "warn",
    "deprecated",
    "fla",
    "low re",
    "large pac",
    "table",
    "pace",
    "health chec",
    "cert",
    "rate l",
)
LEGACY_RETRY_HINTS = ("retr", "re-try", "try aga", "fla")
LEGACY_CRITICAL_HINTS = ("cr",)
RETRY_TYPE = (
    r"(dependency|db|database|deploy|connection|fetch|unit test|integration|build|checkout"
    r"|package|test|api|probe|health)"
)
LEGACY_FINISHED = r"Finished: (SUCCESS|FAILURE|UNSTABLE)"
LEGACY_STAGE_OPEN = r"^\[Pipeline\] \{ \(([^)]+)\)"  # case-sensitive, on the stripped line

# --- fixed values: levels, in order, on upper-cased text ----------------------
LEVEL_WORDS = (
    ("CRITICAL", ("CRITICAL",)),
    ("ERROR", ("[ERROR]", "ERROR:", "FAILED", "FAILURE")),
    ("WARNING", ("[WARNING]", "WARNING:", "WARN:")),
    ("DEBUG", ("[DEBUG]", "DEBUG:")),
)
DEFAULT_LEVEL = "INFO"
PLATFORMS = ("jenkins", "github-actions", "gitlab-ci", "unknown")

# --- fixed values: pipeline-style platform ------------------------------------
PIPELINE_MARKERS = ("[Pipeline]", "Running on Jenkins", "Started by user", "/var/jenkins_home/")
PIPELINE_STAGE_OPEN = r"\[Pipeline\] \{ \(([^)]+)\)"
PIPELINE_FAIL_MARKS = ("FAILED", "FAILURE")
PIPELINE_STARTED_BY = r"Started by (.+)"
PIPELINE_DURATION = r"Duration: (\d+) (sec|min|hr)"
DURATION_SECONDS = {"sec": 1, "min": 60, "hr": 3600}
BUILD_STATUS_PATTERNS = (  # first hit wins, any case
    ("SUCCESS", r"Finished: SUCCESS"),
    ("FAILED", r"Finished: FAILURE|BUILD FAILED"),
    ("UNSTABLE", r"Finished: UNSTABLE"),
    ("TIMEOUT", r"TIMEOUT|TIMED OUT"),
    ("ABORTED", r"ABORTED|CANCELLED"),
)
BUILD_STATUS_HINTS = ("hed: ", "fa", "meout", "med out", "aborted", "cancelled")

# --- fixed values: Actions-style platform -------------------------------------
ACTIONS_MARKERS = (
    "##[group]",
    "::error::",
    "::warning::",
    "github.com",
    "actions/",
    "##[command]",
)
ACTIONS_GROUP = r"##\[group\](.+)"
ACTIONS_COMMAND = r"##\[command\](.+)"
ACTIONS_ERROR_NOTE = r"::error::(.+)"
ACTIONS_WARNING_NOTE = r"::warning::(.+)"
ACTIONS_FAIL_MARKS = ("Error:", "FAILED", "Process completed with exit code")
ACTIONS_FAIL_MASK = "0"
ACTIONS_COMMAND_CHARS = 50
ACTIONS_SUCCESS = r"Completed successfully|Process completed with exit code 0"
ACTIONS_SUCCESS_HINTS = ("ompleted",)

# --- fixed values: limits ------------------------------------------------------
MAX_LOG_CHARS = 10_000_000
PREVIEW_CHARS = 500
TOP_ENTRIES = 10
MARKDOWN_ERRORS = 5
ERROR_MESSAGE_CHARS = 120
WARNING_MESSAGE_CHARS = 100
LEGACY_TOP_ERRORS = 8
LEGACY_TOP_WARNINGS = 7
CHARS_PER_TOKEN = 4
CHUNK_TOKENS = 3000
OVERLAP_LINES = 10
NEIGHBOUR_LINES = 10
NEIGHBOURS_SHOWN = 3
EXPLAIN_PER_LOG = 5
FIX_PER_LOG = 3
MEMO_TTL_SECONDS = 604_800
MEMO_TYPES = ("summaries", "explanations", "fixes")
BALANCED_AT = 0.7
MODERATE_AT = 0.5
SPLIT_SHARES = (("train", 0.70), ("val", 0.15), ("test", 0.15))
SPLIT_SEED = 42

# --- fixed values: error types of a message, first hit wins --------------------
ERROR_TYPE_WORDS = (
    ("Dependency Error", ("dependency", "package", "npm", "pip", "not found")),
    ("Syntax Error", ("syntax", "parse", "unexpected token")),
    ("Test Failure", ("test failed", "assertion", "expect")),
    ("Timeout", ("timeout", "timed out")),
    ("Permission Error", ("permission", "denied", "forbidden")),
    ("Docker/Container Error", ("docker", "container", "image")),
    ("Network Error", ("network", "connection", "refused")),
)
DEFAULT_ERROR_TYPE = "General Error"
STACK_FRAME = (
    rf"at{BLANK}+[\p{{L}}\p{{N}}_.]+\([^)]+\)"
    rf"|File{BLANK}+\"[^\"]+\",{BLANK}+line{BLANK}+\d+"
    rf"|{WORD}+Error:{BLANK}+."
)
STACK_FRAMES_SHOWN = 10

# --- fixed values: text normalisation, in order, on lower-cased text ------------
NORMALISE_STEPS = (
    (r"\d{4}-\d{2}-\d{2}(?:T|" + BLANK + r")\d{2}:\d{2}:\d{2}", ""),
    (r"\d{2}:\d{2}:\d{2}", ""),
    (r"https?://" + NOT_BLANK + "+", "URL"),
    (r"/[a-z0-9_\-/]+/", " "),
    (r"#\d+", ""),
    (r"\d+\.\d+\.\d+", "VERSION"),
    (BLANK + "+", " "),
)

# --- fixed values: structural flags (name, pattern, ignores case) ---------------
STRUCTURAL_FLAGS = (
    ("has_error_keyword", r"\berror\b", True),
    ("has_failed_keyword", r"\bfailed\b", True),
    ("has_exception", r"\bexception\b", True),
    ("has_timeout", r"\btimeout\b|\btimed out\b", True),
    ("has_npm_error", r"\bERR!\b|\bE[A-Z]+\b", False),
    ("has_pip_error", r"\bERROR:\b", False),
    ("has_ts_error", r"\bTS\d+\b", False),
    ("has_syntax_error", r"SyntaxError|IndentationError", False),
    ("has_test_failed", r"\btest.*failed\b|\bfailed.*test\b", True),
    ("has_assertion_error", r"AssertionError|expect.*received", False),
    ("has_stack_trace", BLANK + r"+at" + BLANK + r"+.*\(.*:\d+:\d+\)", False),
    ("has_exit_code", r"exit code|exit status", True),
)
TOKEN = r"[\p{L}\p{N}_]{2,}"
VOCABULARY_SIZE = 500
VOCABULARY_MIN_DOCS = 2
VOCABULARY_MAX_SHARE = 0.8
