"""Rule lists, code tables and texts that results depend on.

Everything here must equal the published contract for results to match, so it is
written out plainly. All tables are a handful of rows; they become literals in
the plan, never broadcast or shuffled data.
"""

# --- fixed values: links -------------------------------------------------
TRACKING_PARAMS = [
    "source", "utm_source", "utm_medium", "utm_campaign",
    "utm_content", "utm_term", "ref", "referrer",
]

# schemes whose last path segment may carry ;params
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtspu",
    "rtsps", "sip", "sips", "mms", "sftp", "tel",
]

LINK_SKIP_PATTERNS = [
    r"help\.medium\.com",
    r"miro\.medium\.com",
    r"cdn-images-\d+\.medium\.com",
    r"medium\.com/plans",
    r"medium\.com/me/",
    r"medium\.com/jobs",
    r"policy\.medium\.com",
    r"medium\.com/\?source=",
    r"medium\.com/$",
    r"itunes\.apple\.com",
    r"play\.google\.com",
    r"\.css$",
    r"\.js$",
    r"\.png$|\.jpg$|\.jpeg$|\.gif$",
]

LINK_ACCEPT_PATTERNS = [
    r"medium\.com/@[\w\-\.]+/[\w\-]+-[a-f0-9]+",
    r"[\w\-]+\.medium\.com/[\w\-]+-[a-f0-9]+",
    r"medium\.com/[\w\-]+/[\w\-]+-[a-f0-9]+",
    r"medium\.com/@[\w\-\.]+/[\w\-]+",
    r"[\w\-]+\.medium\.com/[\w\-]+",
    r"medium\.com/[\w\-]+/[\w\-]+",
]

ALLOWED_HOSTS = [
    "medium.com",
    "towardsdatascience.com",
    "hackernoon.com",
    "uxdesign.cc",
    "levelup.gitconnected.com",
]
ALLOWED_HOST_SUFFIX = ".medium.com"

SECTIONS = [
    ("highlights", 0, r"(?i)today'?s\s+highlights?"),
    ("following", 1, r"(?i)from\s+your\s+following"),
]
# a heading of a section holds one of these, in any case
SECTION_WORDS = ("highlight", "following")
SECTION_ANCESTORS = ["div", "section", "article", "table", "td"]
SECTION_BLOCKS = ["div", "td", "tr"]
NOT_A_TITLE = r"(?i)^(read\s+more|continue\s+reading|view\s+story|medium\.com)$"
NOT_A_TITLE_LINE = r"(?i)^(by\s+|@|read\s+more)"
BY_LINE = r"(?i)by\s+([^,\n\|]+)"
AT_NAME = r"@([\w\-\.]+)"
UNKNOWN_AUTHOR = "Unknown Author"

# --- fixed values: pages -------------------------------------------------
BOILERPLATE_TAGS = ["script", "style", "nav", "header", "footer", "aside"]
CONTENT_BLOCK_TAGS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li"]
CLEAN_SUFFIXES = ["Follow", "Sign up", "Sign in"]

# one sentence; start and repeats are pinned so that text without an end mark is
# scanned once, however long it is
SENTENCE = r"(?<![^.!?])[^.!?]++[.!?]++"

# --- fixed values: payloads and prompts ----------------------------------
PAYLOAD_KEYS = ["body", "content", "html", "message"]
ARTICLE_FIELDS = ["url", "title", "content", "summary", "author"]
PROMPT_LIMIT = 3000
PROMPT_HEAD = "Please provide a concise and informative summary of the following Medium article.\n\nTitle: "
PROMPT_MIDDLE = "\n\nArticle Content:\n"
PROMPT_TAIL = (
    "\n\nInstructions:\n"
    "- Create a summary that captures the main points and key insights\n"
    "- Keep the summary between 2-4 sentences\n"
    "- Focus on the most important information and takeaways\n"
    "- Write in a clear, professional tone\n"
    "- Do not include promotional language or calls to action\n"
    "\nSummary:"
)
FALLBACK_HEAD = "Summary unavailable for '"
FALLBACK_TAIL = "'. The article content could not be processed at this time."
FAILED_SUMMARY = "Summary could not be generated due to processing error"

# --- fixed values: storage, service and stage errors ----------------------
OBJECT_ERRORS = {
    "NoSuchKey": ("object not found", "input_validation"),
    "NoSuchBucket": ("bucket not found", "configuration"),
    "AccessDenied": ("access denied", "authentication"),
}
OBJECT_ERROR_DEFAULT = ("storage error", "external_service")

SERVICE_ERRORS = {
    "ThrottlingException": "retryable",
    "ServiceUnavailableException": "retryable",
    "InternalServerException": "retryable",
    "ValidationException": "fatal",
    "AccessDeniedException": "fatal",
}
SERVICE_ERROR_DEFAULT = "retryable"

STAGE_ERRORS = {
    "validation": (400, "Validation error"),
    "authentication": (401, "Authentication error"),
    "fetch": (500, "Fetch error"),
    "fatal": (500, "Internal server error"),
}

AUTHENTICATION_MESSAGE = "Failed to authenticate with Medium"

# error type -> root of its class family
ERROR_ROOTS = {
    "ValidationError": "validation",
    "AuthenticationError": "authentication",
    "RetryableError": "retryable",
    "RateLimitError": "retryable",
    "NetworkError": "retryable",
    "ClientError": "client",
}
RETRYABLE_TYPES = ["RetryableError", "RateLimitError", "NetworkError"]
FATAL_TYPES = ["FatalError", "AuthenticationError", "ValidationError"]

# --- fixed values: retry policies (name, retries, base, factor, cap) ------
RETRY_POLICIES = [
    ("article", 3, 1.0, 2.0, 60.0),
    ("model", 3, 2.0, 2.0, 60.0),
    ("webhook", 3, 1.0, 2.0, 60.0),
    ("parse_service", 3, 2.0, 2.0, None),
    ("parse_task", 2, 1.0, 2.0, None),
    ("fetch_service", 3, 2.0, 2.0, None),
    ("fetch_task", 5, 10.0, 2.0, None),
    ("summarize_service", 3, 3.0, 2.0, None),
    ("summarize_task", 2, 5.0, 2.0, None),
    ("deliver_service", 3, 2.0, 2.0, None),
    ("deliver_task", 3, 1.0, 2.0, None),
]

# --- fixed values: alerts ---------------------------------------------------
SEVERITY = {
    "CRITICAL": ("\U0001F6A8", "danger"),
    "ERROR": ("⚠️", "warning"),
    "WARNING": ("⚡", "good"),
}
SEVERITY_DEFAULT = ("⚠️", "warning")
IMPORTANT_KEYS = ["function_name", "request_id", "url", "bucket", "key", "execution_arn", "status_code"]
HIDDEN_KEYS = ["timestamp", "level", "message", "error", "metrics"]
SUGGESTIONS = {
    "input_validation": "Check input data format and required fields",
    "authentication": "Verify credentials in Secrets Manager and check IAM permissions",
    "external_service": "Check service status and retry limits, verify network connectivity",
    "rate_limit": "Implement exponential backoff and reduce request frequency",
    "network": "Check network connectivity and DNS resolution",
    "configuration": "Verify environment variables and resource configurations",
    "processing": "Review input data and processing logic",
}
SUGGESTION_DEFAULT = "Review logs and check system status"
SUGGESTION_SUFFIXES = [
    (["Timeout"], ", increase timeout values"),
    (["Permission", "Access"], ", check IAM roles and policies"),
    (["NotFound"], ", verify resource exists and paths are correct"),
]

# --- fixed values: run outcomes ---------------------------------------------
RUN_MESSAGES = {
    "complete": (200, "Processing completed successfully"),
    "no_links": (200, "No articles found in email content"),
    "none_fetched": (206, "No articles could be fetched successfully"),
    "parse_error": (400, "Failed to parse email content"),
    "fetch_error": (500, "Critical error during article fetching"),
    "summarize_error": (500, "Critical error during article summarization"),
}
ALL_FETCHES_FAILED = "All article fetch attempts failed"
ITEM_STATUSES = ["ok", "failed", "failed_summary", "summary_success_slack_failed"]
FAILED_EXECUTIONS = ["FAILED", "TIMED_OUT", "ABORTED"]

# --- fixed values: limits ---------------------------------------------------
RETENTION_DAYS = 30
NONCURRENT_DAYS = 7
SCALING_LIMIT = 5.0
THROUGHPUT_FLOOR = 1.0
SINGLE_ITEM_LIMIT = 2.0
MEMORY_LIMIT_MB = 100.0
RATE_PROFILES = [(60, 2.0), (30, 5.0), (45, 3.0)]
