"""Fixed values of the moderation and curation rules, in one place."""

# Keywords, each counted once per text by containment.
CONTACT_KEYWORDS = ["call", "whatsapp", "contact", "reach me", "text me", "number is", "hmu", "dm me"]
QUANTITY_KEYWORDS = ["units", "qty", "pcs", "model", "sku", "$", "price"]
PLATFORM_KEYWORDS = ["insta", "instagram", "telegram", "snap", "snapchat", "discord", "line", "kik", "wa", "whatsapp", "fb", "facebook"]

# Patterns over canonical text.
EMAIL = r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
URL = {
    "pipeline": r"(?i)(https?://[^\s]+)|(www\.[^\s]+)|([a-zA-Z0-9.-]+\.(com|org|net|io|co|me|ly)(?:/[^\s]+)?)",
    "standalone": r"(?i)(https?://[^\s]+)|(www\.[^\s]+)|([a-zA-Z0-9.-]+\.(com|org|net|io|co|me|ly)(?:\s*/[\w-]+)?)",
}
PATH_CONTINUATION = r"^\s*[\(\[]?[a-zA-Z]{0,15}[\)\]]?(?:/[^\s]+)+"
PHONE_SHAPE = r"\d{3}[-\s]?\d{3}[-\s]?\d{4}"
DOMAIN = r"(?i)\b[a-zA-Z0-9-]+\.(com|org|net|io|co|me|ly|to|gg)\b"
BARE_HANDLE = r"^[\w.]{3,20}$"
AT_WORDS = "at|aat|@"
DOT_WORDS = r"dot|dawt|daht|d0t|\."

# Number words and the letters that leet digits stand for.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
LEET_DIGITS, LEET_LETTERS = "0123456789", "oizeasgtbg"

# Weights of the score, in the order of summation, and its thresholds.
WEIGHTS = [("run", 0.25), ("contact", 0.20), ("pattern", 0.15), ("history", 0.15), ("link", 0.15), ("platform", 0.10)]
LOW_BELOW, HIGH_FROM, FLOOR = 35, 65, 35
HISTORY_FLOOR_AT, PLATFORM_FLOOR_AT, HISTORY_DIGITS = 0.7, 1.0, 10

# Lifetimes in seconds and sizes of the keyed state.
DIGIT_TTL, TURN_TTL, SUSPICION_TTL = 120, 180, 600
DIGITS_KEPT, TURNS_KEPT, SUSPICION_ESCALATES = 15, 5, 3

# Checks of corpus options and of near-duplicates.
OPTION_COUNT, OPTION_MIN_WORDS, GATE_DIGITS = 3, 4, 7
DROP_AT, REVIEW_AT, SPOT_CHECK_SHARE, BALANCE_FLOOR_PCT = 0.92, 0.85, 0.05, 90
LANGUAGE_MIX_SHARE, LANGUAGE_MIX_BATCH = 0.25, 10
IDS_TO_REMOVE = [
    "clean_digit_heavy_0376", "social_handle_0283", "clean_ordinary_0099", "clean_ordinary_0079", "clean_digit_heavy_0315", "clean_digit_heavy_0397",
    "clean_keyword_adjacent_0114", "clean_ordinary_0151", "social_handle_0120", "clean_ordinary_0078", "clean_digit_heavy_0235", "clean_ordinary_0139",
    "clean_ordinary_0107", "social_handle_0084", "clean_keyword_adjacent_0209", "clean_ordinary_0159",
]
