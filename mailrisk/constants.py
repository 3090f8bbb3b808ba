"""Fixed values.

Everything in this module is a value that must equal the behaviour being
reproduced (label spellings, column-name candidates, keyword groups, reason
texts, thresholds). They are stated plainly and in their natural order.
Regular expressions for the two SQL dialects (Java for Spark, RE2 for the
DuckDB oracle) are *built* from these lists in ``functions/regex.py``.
"""

# --------------------------------------------------------------------------
# FIXED VALUES: label spellings (after trim + lower-case)
# --------------------------------------------------------------------------
SPAM_SPELLINGS = ["spam", "sp", "1", "true", "yes"]
HAM_SPELLINGS = ["ham", "not spam", "not_spam", "non-spam", "nonspam", "0", "false", "no"]

# --------------------------------------------------------------------------
# FIXED VALUES: column-name candidates, in preference order
# --------------------------------------------------------------------------
SUBJECT_CANDIDATES = ["subject", "title"]
BODY_CANDIDATES = ["body", "email", "text", "message", "content"]
LABEL_CANDIDATES = ["label", "spam", "class", "target", "is_spam"]
SENDER_CANDIDATES = ["sender", "from", "from_email", "email_from"]
RECIPIENT_CANDIDATES = ["recipient", "receiver", "to", "to_email"]
URLS_CANDIDATES = ["urls", "url", "links"]

# CSV cells that pandas reads as missing values (default na_values).
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --------------------------------------------------------------------------
# FIXED VALUES: language rules, in reporting order (label, keyword group).
# Keywords are regex fragments matched as whole words on lower-cased
# "subject\nbody".  Rule 3 (verification) is composite and listed apart.
# --------------------------------------------------------------------------
REASON_URGENT = "Urgent or threatening language detected"
REASON_CREDENTIALS = "Requests for passwords or credentials detected"
REASON_VERIFICATION = "Account verification or login request detected"
REASON_FINANCIAL = "Financial or payment request detected"
REASON_PRIZE = "Prize or scam language detected"
REASON_PROMO = "Promotional or sales-heavy language detected"
REASON_CTA = "Suspicious call-to-action language detected"

URGENT_WORDS = ["urgent", "immediately", "act now", "final notice", "expires?", r"within \d+ hours",
                "suspend", "locked", "blocked", "terminate", "legal action"]
CREDENTIAL_WORDS = ["password", "passcode", "otp", "one[- ]time password", "username", "credentials",
                    "login details", "security code"]
VERIFY_LEAD_WORDS = ["verify", "verification", "confirm"]
VERIFY_OBJECT_WORDS = ["account", "identity", "login", "profile"]
VERIFY_GAP_MAX = 60
SIGN_IN_WORDS = ["sign in", "log in", "login"]
FINANCIAL_WORDS = ["payment", "invoice", "bank", "wire", "transfer", "credit card", "debit card", "refund",
                   "money", "cash"]
PRIZE_WORDS = ["congratulations", "winner", "prize", "lottery", "free money", "claim your", "you have won"]
PROMO_WORDS = ["offer", "discount", "sale", "limited time", "promotion", "cheap", "free", "buy now",
               "special deal", "unsubscribe"]
CTA_WORDS = ["click here", "verify now", "download", "open attachment", "enable", "reply immediately",
             "call now"]

REASON_URL_COUNT_SUFFIX = " external URL(s) detected"
REASON_URL_HTTP = "HTTP URL detected (not HTTPS)"
REASON_URL_IP = "URL uses an IP-address host"
REASON_URL_SENSITIVE = "URL contains a potentially sensitive-action pattern"
URL_ERROR_BRACKETS = "Invalid IPv6 URL"
URL_ERROR_NFKC_SUFFIX = "' contains invalid characters under NFKC normalization"
REASON_URL_INVALID = "Invalid URL pattern detected"
URL_SENSITIVE_SUBSTRINGS = ["login", "verify", "secure", "account", "payment"]
URL_TRAILING_STRIP = ".,);]"

REASON_CAPITALS = "Excessive capital-letter usage detected"
CAPITALS_MIN_LETTERS = 20
CAPITALS_SHARE = 0.35
REASON_PUNCTUATION = "Excessive punctuation detected"
PUNCTUATION_MIN_RUNS = 2
REASON_SOCIAL = "Social-engineering language detected"
SOCIAL_WORDS = ["gift card", "keep this confidential", "do not tell", "secret"]

# --------------------------------------------------------------------------
# FIXED VALUES: safe (HAM-supporting) reasons
# --------------------------------------------------------------------------
SAFE_NO_URLS = "No external URLs detected"
SAFE_NO_PROMO = "No strong promotional/prize language detected"
SAFE_NO_CREDENTIALS = "No suspicious credential/account request detected"
SAFE_NO_SENDER = "Sender information was not provided"

# --------------------------------------------------------------------------
# FIXED VALUES: topic categories for HAM mail, first match wins
# --------------------------------------------------------------------------
TOPICS = [
    ("Education", ["class", "course", "lecture", "student", "teacher", "professor", "university", "college",
                   "school", "assignment", "exam", "education", "academic", "scholarship", "admission"]),
    ("Work", ["meeting", "project", "office", "client", "team", "deadline", "agenda", "work", "job",
              "interview", "colleague", "manager", "employee", "report"]),
    ("Finance", ["bank", "statement", "salary", "account balance", "transaction", "tax", "investment", "loan",
                 "invoice", "budget", "finance"]),
    ("Personal", ["family", "friend", "birthday", "dinner", "lunch", "vacation", "travel", "personal", "photos",
                  "weekend"]),
    ("Social", ["event", "community", "club", "social", "party", "invite", "invitation", "volunteer",
                "networking"]),
    ("Promotion", ["newsletter", "catalog", "announcement", "offer", "discount", "sale", "promotion", "deal"]),
]
TOPIC_DEFAULT = "General"

# --------------------------------------------------------------------------
# FIXED VALUES: sender checks
# --------------------------------------------------------------------------
SENDER_NO_AT = "Sender does not contain a standard email address format"
SENDER_NO_AT_SCORE = 60
SENDER_UNUSUAL = "Sender has an unusual email address format"
SENDER_UNUSUAL_SCORE = 45
SENDER_DOMAIN_SHAPE = "Sender domain has an unusual structure"
SENDER_DOMAIN_SHAPE_SCORE = 35
SENDER_ROLE = "Sender uses a role-based or automated mailbox pattern"
SENDER_ROLE_WORDS = ["noreply", "no-reply", "mailer", "marketing", "promo", "support", "admin"]
SENDER_SENSITIVE = "Sender domain contains a sensitive-action keyword"
SENDER_SENSITIVE_WORDS = ["verify", "secure-login", "account-alert", "payment"]
SENDER_SENSITIVE_SCORE = 35
SENDER_CONTEXT_PER_SIGNAL = 4
SENDER_CONTEXT_MAX = 25
SENDER_VERIFICATION_EMPTY = "Sender verification unavailable"
SENDER_VERIFICATION = "Domain reputation verification unavailable"
URL_REPUTATION = "Reputation verification unavailable"

# --------------------------------------------------------------------------
# FIXED VALUES: model, risk and reasons
# --------------------------------------------------------------------------
SUBJECT_PREFIX = "Subject: "
SPAM = "SPAM"
HAM = "HAM"
SPAM_THRESHOLD = 50.0
RISK_LEVELS = [(85, "CRITICAL"), (65, "HIGH"), (35, "MEDIUM")]
RISK_LEVEL_DEFAULT = "LOW"
URL_RISK_PER_URL = 25
CONTEXT_RISK_PER_SIGNAL = 12
OVERALL_WEIGHTS = (0.75, 0.15, 0.10)   # spam_risk, url_risk, context_risk
EXPLAIN_TOP_K = 5
EXPLAIN_MIN_TERM_LEN = 3
SPAM_TERMS_PREFIX = "Model-weighted spam indicators: "
HAM_TERMS_PREFIX = "Model-weighted safe indicators: "
SPAM_FALLBACK = "Model probability indicates this message is more likely to be spam"
HAM_FALLBACK = "No strong spam indicators were detected by the analysis pipeline"
UNKNOWN_SENDER = "Unknown sender"

# Vectoriser / classifier settings of the retraining job.
MIN_DF = 2
MAX_DF = 0.995
MAX_FEATURES = 250_000
TEST_SHARE = 0.2
SPLIT_SEED = 42
REG_PARAM = 1e-4
