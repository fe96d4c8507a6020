"""Fixed values.

Everything in this file has to equal a published constant, list, pattern or
format for results to agree; it is data, not logic.
"""

# ---- energy and CO2 ---------------------------------------------------------
EMISSION_FACTOR_G_PER_KWH = 250.0
CPU_TDP_W = 65.0
GPU_MAX_W = 150.0
SAMPLE_STEP_S = 0.5
GRAMS_PER_PHONE_CHARGE = 8.22
GRAMS_PER_CAR_KM = 120.0
LED_HOURS_PER_GRAM = 100.0
SMOOTHING_ROWS = 20

# ---- profiling --------------------------------------------------------------
CATEGORICAL_LIMIT = 20
NUMERIC_TEXT_SHARE = 0.6
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

SEMANTIC_PATTERNS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "phone_international": r"^\+?[1-9]\d{6,14}$",
    "italian_tax_code": r"^[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]$",
    "iban": r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$",
    "postal_code_generic": r"^[A-Za-z0-9\s\-]{3,10}$",
    "ssn_usa": r"^\d{3}-?\d{2}-?\d{4}$",
    "nin_uk": r"^[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]$",
    "sin_canada": r"^\d{3}\s?\d{3}\s?\d{3}$",
    "tfn_australia": r"^\d{8,9}$",
    "passport_generic": r"^[A-Za-z0-9]{6,9}$",
    "passport_uk": r"^\d{9}$",
    "passport_usa": r"^\d{9}$",
    "aadhaar_india": r"^\d{4}\s?\d{4}\s?\d{4}$",
    "credit_card": r"^(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13}|6(?:011|5\d{2})\d{12})$",
    "ipv4": r"^(?:\d{1,3}\.){3}\d{1,3}$",
    "ipv6": r"^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$",
    "mac_address": r"^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$",
}

#: Characters of what each pattern matches, from and to (None: any number); values of other lengths need no search.
SEMANTIC_LENGTHS = {
    "email": (6, None), "phone_international": (7, 16), "italian_tax_code": (16, 16), "iban": (14, 34), "postal_code_generic": (3, 10),
    "ssn_usa": (9, 11), "nin_uk": (9, 9), "sin_canada": (9, 11), "tfn_australia": (8, 9), "passport_generic": (6, 9), "passport_uk": (9, 9),
    "passport_usa": (9, 9), "aadhaar_india": (12, 14), "credit_card": (13, 16), "ipv4": (7, 15), "ipv6": (15, 39), "mac_address": (17, 17),
}

VALUE_KIND_PATTERNS = {
    "url": r"^(?i:https?|ftp|file)://",
    "path": r"^(?:[a-zA-Z]:\\|/|\\|\.\.?\\)",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
}

# ---- sensitive column names (category, pattern) -----------------------------
SENSITIVE_KEYWORDS = [
    ("personal_identifier", r"\b(nome|first[_ ]?name)\b"),
    ("personal_identifier", r"\b(cognome|last[_ ]?name)\b"),
    ("personal_identifier", r"\b(username|user[_ ]?id|account[_ ]?id)\b"),
    ("personal_identifier", r"\b(codice[_ ]?fiscale|cf)\b"),
    ("personal_identifier", r"\b(ssn|nin|tax[_ ]?id|codice[_ ]?tributario)\b"),
    ("personal_identifier", r"\b(passport|passaporto)\b"),
    ("personal_identifier", r"\b(driver[_ ]?license|patente)\b"),
    ("contact", r"\b(email|e[-_ ]?mail)\b"),
    ("contact", r"\b(telefono|phone|cell(ulare)?|mobile|whatsapp)\b"),
    ("contact", r"\b(handle|twitter|instagram|linkedin)\b"),
    ("address", r"\b(indirizzo|address|via|street|avenue|viale|piazza)\b"),
    ("address", r"\b(cap|zip|post[_ ]?code)\b"),
    ("address", r"\b(citt[aà]|city|provincia|province|paese|country|stato|region)\b"),
    ("demographic", r"\b(data[_ ]?di[_ ]?nascita|dob|birth(date| day)?)\b"),
    ("demographic", r"\b(luogo[_ ]?di[_ ]?nascita|place[_ ]?of[_ ]?birth)\b"),
    ("demographic", r"\b(et[aà]|age)\b"),
    ("demographic", r"\b(genere|sesso|gender)\b"),
    ("demographic", r"\b(nazionalit[aà]|cittadinanza|nationality)\b"),
    ("demographic", r"\b(religion(e)?|religious|politic(al|he)|partito)\b"),
    ("demographic", r"\b(salute|health|disabilit[aà]|disability|diagnos[ie])\b"),
    ("financial", r"\b(iban|bic|swift)\b"),
    ("financial", r"\b(carta[_ ]?di[_ ]?credito|credit[_ ]?card|pan)\b"),
    ("financial", r"\b(iban|conto|account|iban)\b"),
    ("financial", r"\b(salary|stipendio|reddito|income|busta[_ ]?paga)\b"),
]
SENSITIVE_SPELLINGS = ["email", "(phone|tel|cell)"]
SENSITIVE_POINTS = 2
SENSITIVE_THRESHOLD = 2
PII_SHARE_PCT = 10.0

# ---- SQL text ---------------------------------------------------------------
SQL_KEYWORDS = ["SELECT", "WITH", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"]
NON_SQL_MARKERS = [
    r"^\s*#{2,}.*$",
    r"^\s*[-*]\s",
    r"```",
    r"\btest\s*cases?\b",
    r"\bexamples?\b",
]
MAX_CANDIDATES = 5
DBMS_COLUMNS = ["MySQL", "SQLite", "PostgreSQL", "DuckDB", "SQL Server"]

# ---- synthetic data ---------------------------------------------------------
LOCALES = ["en_US", "it_IT", "fr_FR", "de_DE", "es_ES", "pt_BR", "ja_JP", "zh_CN"]
FAKE_PROVIDERS = {
    "Personal": ["name", "first_name", "last_name", "prefix", "suffix"],
    "Contact": ["email", "phone_number", "address", "street_address", "city", "state", "zipcode", "country"],
    "Internet": ["url", "domain_name", "ipv4", "ipv6", "mac_address", "user_name"],
    "Business": ["company", "job", "catch_phrase", "bs"],
    "Financial": ["credit_card_number", "credit_card_provider", "iban", "bban"],
    "Date/Time": ["date", "date_time", "time", "year"],
    "Text": ["text", "sentence", "paragraph", "word"],
    "Numeric": ["random_int", "random_number", "pyfloat"],
}

# ---- delimited files --------------------------------------------------------
DELIMITERS = [",", ";", "\t", "|"]
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Fixed value: how a fenced block in generated text is found.
FENCED_BLOCK = r"(?is)```(?:\s*sql)?\s*\n(.*?)```"
