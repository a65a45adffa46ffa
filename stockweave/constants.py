"""Fixed values. Results are only right with exactly these values."""

# Texts read as a missing cell.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Standard record fields, column roles, catalogue modes.
STANDARD_FIELDS = ("id", "name", "description", "category")
TRAINING_FIELDS = ("name", "description", "category")
ALL_ROLES = ("training", "metadata", "filter")
MODES = ("replace", "append")

# Status domain; a job in one of the first three states is still running.
RUNNING_STATUSES = ("pending", "queued", "processing")
STATUSES = ("pending", "queued", "processing", "completed", "failed", "canceled")
STATUS_TTL_SECONDS = 86400

# Percent done after each stage of a build.
STAGE_PROGRESS = {"loaded": 10, "embedded": 30, "samples": 50, "completed": 100}

# Defaults.
BATCH_SIZE = 128
MAX_TOKENS = 512
VALIDATION_SPLIT = 0.2
MAX_ITEMS = 10
CHAT_ITEMS = 5
PAGE_SIZE = 10
SEARCH_PAGE_SIZE = 20
MIN_SCORE = 0.2
CONTEXT_RESULTS = 3
TRAINING_STEPS = 100
EMBED_BATCH = 32
PRICE_MAX = 9007199254740991

# Defaults of absent job message fields.
JOB_DEFAULTS = {
    "timestamp": "unknown",
    "name": "Unnamed",
    "model_path": "unknown",
    "mode": "replace",
}

# Training question and answer templates.
QUESTION_TEMPLATES = (
    ("Do you have {name}?",
     "Yes, we have {name}. {description}"),
    ("Tell me about {name}",
     "{name} is {description}. It belongs to the {category} category."),
    ("What products do you have in {category}?",
     "In {category}, we have {name}. {description}"),
)
FIELD_TEMPLATE = ("What is the {key} of {name}?", "The {key} of {name} is {value}.")

# Prompt layout.
PROMPT_WITH_RESPONSE = "Query: {query}\nContext: {context}\nResponse: {response}"
PROMPT_OPEN = "Query: {query}\nContext: {context}\nResponse: "
RESPONSE_MARK = "Response: "

# Fixed answers.
NO_RESULTS_TEXT = "No matching products found."
EMPTY_RESPONSE_TEXT = "I couldn't generate a meaningful response."
PROMPT_FAILED_TEXT = "I apologize, but I couldn't process your query."
CONTEXT_HEADER = "Available products:"
RESULTS_HEADER = "### Found Products:"

# Chat rules in order (first match wins) and the canned replies.
CHAT_PATTERNS = (
    ("greeting", "hi|hello|hey|greetings"),
    ("farewell", "bye|goodbye|thank you|thanks|cya"),
    ("help", "help|assist|support"),
)
CHAT_REPLIES = {
    "greeting": (
        "Hello! How can I help you find products today?",
        "Hi there! Looking for something specific?",
        "Welcome! What kind of products are you interested in?",
    ),
    "farewell": (
        "Thank you for chatting! Let me know if you need anything else.",
        "Have a great day! Feel free to come back if you need more help.",
        "Goodbye! Don't hesitate to ask if you have more questions.",
    ),
    "help": (
        "I can help you find products, check prices, and provide product "
        "information. What would you like to know?",
    ),
    "unknown": (
        "I'm not sure about that. Would you like to search our products?",
        "I might need more details to help you better. Could you be more specific?",
        "I'm still learning, but I can help you search for products if you'd like.",
    ),
}

# Messages of the record checks.
CONFIG_ERRORS = {
    "name": "name is required",
    "data_source_type": "data_source.type is required",
    "mode": "mode must be either 'replace' or 'append'",
    "previous_version": "previous_version is required for append mode",
    "name_column": "schema_mapping.name_column is required",
    "id_column": "schema_mapping.id_column is required",
}
PREVIOUS_VERSION_ERROR = "previous version not found or not completed"
UNKNOWN_CONFIG_ERROR = "config not found"
