"""Values that the results depend on. Everything below is data, not logic."""

# ---------------------------------------------------------------------------
# Schema versions. They enter every content hash, so raising one
# invalidates the rows derived from the older shape.
# ---------------------------------------------------------------------------
EXTRACTION_VERSION = "2"
SEGMENT_VERSION = "1"
REPORT_VERSION = "2"
RECEIPT_VERSION = "1"
SALIENCE_VERSION = "1"
PACKET_VERSION = "1"
SCOUT_REPORT_VERSION = "3"
DOMAIN_DRAFT_VERSION = "2"

# Bounds and budgets.
DEDUPE_MIN_CHARS = 200
REPORT_MAX_BYTES = 8_192
SCOUT_REPORT_MAX_BYTES = 24_576
REPORT_MAX_EVIDENCE = 12
QUOTE_MAX_CHARS = 200
STAGES = {
    "A": {"packets": 6, "packet_tokens": 50_000, "source_tokens": 300_000},
    "B": {"packets": 6, "packet_tokens": 50_000, "source_tokens": 300_000},
}
STARTER_CANDIDATES = (
    {"segments": 4, "segment_tokens": 25_000},
    {"segments": 6, "segment_tokens": 25_000},
    {"segments": 8, "segment_tokens": 25_000},
)
STARTER_MAX_TOKENS = 160_000

# Log sources, domains, evidence vocabulary.
SOURCES = ("codex", "claude", "copilot", "opencode", "antigravity", "custom")
DOMAINS = ("work", "design", "write", "video")
EVIDENCE_KINDS = ("inferred", "explicit")
REGISTERS = ("casual", "professional", "shared")
REGISTER_HEADINGS = (
    ("shared", "## Voice laws"),
    ("casual", "## Casual register"),
    ("professional", "## Professional register"),
)
SIGNAL_FAMILIES = (
    "directive", "correction", "rejection", "preference", "recurrence", "exploration", "verification",
)
GENERIC_RULES = (
    "be helpful", "be concise", "communicate clearly", "follow best practices", "write clean code",
    "write good code",
)

# A raw log line holding none of these is never decoded.
USER_LINE_MARKERS = (
    '"role":"user"', '"role": "user"', '"type":"user"', '"type": "user"', '"type":"user.message"',
    '"type": "user.message"', '"type":"USER_INPUT"', '"type": "USER_INPUT"',
)

# Text a harness injected into a user turn starts with one of these.
INJECTED_PREFIXES = (
    "# AGENTS.md instructions",
    "# CLAUDE.md instructions",
    "# Context from my IDE setup:",
    "# Files mentioned by the user",
    "<environment_context",
    "<in-app-browser-context",
    "<permissions instructions",
    "<recommended_plugins",
    "<summary>",
    "<command-name",
    "<command-message",
    "<local-command-stdout",
    "<task-notification",
    "<launch-selected-element",
    "[Request interrupted",
)

# Control envelopes and attachment markers (Java regex).
ENVELOPE_TAGS = (
    "subagent_notification", "codex_internal_context", "codex_delegation", "turn_aborted", "heartbeat",
)
IMAGE_MARKER = r"</?image\b[^>]*>?"
USER_REQUEST = r"(?s)<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>"

# Secret and personal-data patterns with their replacement, in the
# order they apply. (?U) gives \d, \w, \s and \b their Unicode meaning.
REDACTION_RULES = (
    (r"sk-[A-Za-z0-9]{20,}", "[OPENAI_KEY]"),
    (r"sk_live_[A-Za-z0-9]{20,}", "[STRIPE_KEY]"),
    (r"whsec_[A-Za-z0-9]{20,}", "[WEBHOOK_SECRET]"),
    (r"sbp_[A-Za-z0-9]{20,}", "[SUPABASE_TOKEN]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[GITHUB_TOKEN]"),
    (r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "[JWT]"),
    (r"AKIA[0-9A-Z]{16}", "[AWS_KEY]"),
    (r"xox[baprs]-[A-Za-z0-9\-]{10,}", "[SLACK_TOKEN]"),
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    (r"(?U)(?<![\w.\-/])(?:\+\d{1,3}[\s\-]?(?:\(\d{1,4}\)[\s\-]?)?\d(?:[\s\-]?\d){6,10}"
     r"|\(?0[2-9]\d{0,2}\)?(?:[\s\-]?\d){6,9})(?![\w/]|[.\-]\d)", "[PHONE]"),
    (r"(?iU)(api[_-]?key|secret|token|password|passwd)\s*[:=]\s*\S+", "$1=[REDACTED]"),
)
CREDENTIAL_KEY = r"pass(?:word|wd|phrase)|psk|passkey|wifi\s+key"
CREDENTIAL_JOINER = r"\s*(?:is\s+|=\s*|:\s*)?['\"]?"
CREDENTIAL_CHAR = r"[^\s'\",;]"
CREDENTIAL_MIN_CHARS = 6
CREDENTIAL_SURE_CHARS = 12

# Lines that look like a stack trace (Java regex, one line each).
TRACE_LINE = r"(?U)(?:^\s+at )|Exception|Traceback|\.(?:java|py|ts|js|kt):\d|(?:^\s*File \")"
TRACE_MIN_LINES = 4
TRACE_SHARE = 0.25

# Salience and domain markers, matched as substrings of the
# normalised text with one blank on either side.
SALIENCE_MARKERS = {
    "directive": ("never", "always", "do not", "don't", "must", "make sure", "need to", "remember", "אל ", "תמיד", "חייב"),
    "correction": ("wrong", "not what", "stop", "instead", "fix this", "you missed", "זה לא", "לא נכון"),
    "rejection": ("hate", "reject", "no ", "don't", "do not", "fake", "bad", "שונא", "אל "),
    "preference": ("prefer", "i want", "i like", "i love", "should", "style", "taste", "voice", "אני רוצה", "מעדיף"),
    "verification": ("done", "live", "verify", "verified", "production", "test", "proof", "בדיקה", "מוכן"),
}
SALIENCE_WEIGHTS = {"directive": 24, "correction": 20, "rejection": 18, "preference": 12, "verification": 10}
RECURRENCE_STEP = 6
RECURRENCE_CAP = 24
DOMAIN_MARKERS = {
    "work": ("done", "verify", "test", "production", "release", "deploy", "plan", "debug", "commit", "proof", "workflow"),
    "design": ("ui", "ux", "design", "visual", "layout", "screenshot", "color", "pixel", "animation", "premium",
               "gradient", "icon", "figma", "css", "עיצוב", "ממשק", "צבע"),
    "write": ("write", "copy", "tweet", "reddit", "marketing", "title", "tone", "voice", "post", "reply", "launch",
              "lowercase", "em dash", "wording", "כתיבה", "פוסט", "שיווק"),
    "video": ("video", "remotion", "hyperframes", "render", "footage", "caption", "subtitle", "scene", "timeline",
              "gsap", "keyframe", "mp4", "shorts", "trailer", "storyboard", "voiceover", "chatterbox", "musicgen",
              "sfx", "youtube", "thumbnail", "composition", "וידאו", "סרטון"),
}

# Thresholds and phrases of the usage report.
REPEAT_MIN_RUN = 3
REPEAT_MIN_WORDS = 4
REWORD_MIN_RUN = 3
REWORD_MIN_OVERLAP = 0.75
REWORD_MIN_WORDS = 6
REWORD_MAX_LINE_BREAKS = 4
EXCERPT_CHARS = 120
FINDING_RECEIPTS = 3
SHORT_PROMPT_WORDS = 5
RESTATED_MIN = 3
CORRECTION_RATE_MIN = 5
CORRECTION_OPENERS = (
    "no ", "no,", "no.", "nope", "not that", "not what i", "that's not", "thats not", "that's wrong",
    "thats wrong", "that is wrong", "still not", "still wrong", "still broken", "wrong", "undo", "revert that",
    "stop,",
)
CORRECTION_EXCLUSIONS = (
    "no need", "no problem", "no worries", "no idea", "no rush", "no hurry", "no big deal", "no clue",
)
RESTATED_MARKERS = (
    "i already told you", "i already said", "i just told you", "as i said", "like i said", "i told you",
    "i said before", "i keep telling you", "as i mentioned", "i've told you", "ive told you", "i already asked",
)
FINDING_KEYS = ("repeat_sends", "restated_context", "reword_loops", "corrections")

# Quote tracing.
TRACE_MIN_WORDS = 4
CURLY_QUOTE = "“([^“”]{1,400})”"

# Quiet-session scan and inbox.
QUIET_SECONDS = 120
INBOX_MAX_RECEIPTS = 256
INBOX_MESSAGE_CHARS = 2_000
INBOX_SESSION_BYTES = 65_536

# Candidate policy.
PROHIBITED_RISKS = (
    "security", "credentials", "permissions", "destructive", "purchase", "legal", "medical", "financial",
    "external-communication",
)
CANDIDATE_KINDS = ("directive", "correction", "preference", "workflow", "retirement")

# Paired experiment.
BASELINE_CONDITION = "cold"
TREATED_CONDITION = "treated"
FAMILIES = ("work", "design", "write")
VARIANTS = ("primary", "held-out")
TRIALS = (1, 2)
WILSON_Z = 1.959963984540054
RETRYABLE_STATUS = ("provider_error", "host_error_before_output")
DESTRUCTIVE_COMMANDS = (
    r"(?i)\brm\s+-rf\b", r"(?i)\bremove-item\b.*\b-recurse\b", r"(?i)\bgit\s+reset\s+--hard\b",
)
SPAM_PHRASES = (
    r"(?i)\bstar\b.*\brepost\b", r"(?i)\bcomment\s+[A-Z0-9_-]+\b", r"(?i)\bguaranteed\b", r"(?i)\bact now\b",
)
X_CHANNEL_CHARS = 280
PROHIBITED_CLAIMS = (
    "p-value", "p value", "statistically significant", "significance", "model ranking", "1000x", "star forecast",
    "traffic forecast",
)

# Privacy scan.
SECRET_PATTERNS = (
    r"\b(?:sk|ghp|github_pat)-[A-Za-z0-9_-]{12,}\b",
    r"(?i)\b(?:api[_ -]?key|token|password)\s*[:=]\s*\S+",
)
WINDOWS_HOME = r"(?i)\b[A-Z]:\\Users\\[^\\\s]+(?:\\[^\s]*)?"
LINUX_HOME = r"/home/[^/\s]+(?:/[^\s]*)?"
MAC_HOME = r"/Users/[^/\s]+(?:/[^\s]*)?"
PUBLIC_EXTENSIONS = (
    ".json", ".html", ".md", ".txt", ".css", ".js", ".vtt", ".srt", ".png", ".jpg", ".jpeg", ".webp", ".mp4",
)
TEXT_EXTENSIONS = (".json", ".html", ".md", ".txt", ".css", ".js", ".vtt", ".srt")
RAW_PRIVATE_NAMES = ("you.md", "you-writer.md", "you-designer.md", "profile.json", "receipts.json")

# Accounts.
SUBSCRIPTION_EVENTS = (
    "subscription.created", "subscription.active", "subscription.updated", "subscription.canceled",
    "subscription.uncanceled", "subscription.past_due", "subscription.revoked",
)
WRITE_STATES = ("trialing", "active", "past_due", "grace")
GRACE_DAYS = 7
RECOVERY_DAYS = 30
MAX_GENERATIONS = 500
MAX_ACCOUNT_BYTES = 64 * 1024 * 1024
MAX_DEVICES = 5
EXPORT_ROWS = 500
RETAINED_DIAGNOSTICS = 100
