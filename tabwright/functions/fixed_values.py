"""Names, word lists and thresholds that decide results.

They are data, not logic; changing one changes answers.
"""

# Column roles, task types and target types.
ROLES = (
    "numeric-continuous", "numeric-discrete", "categorical-nominal",
    "categorical-ordinal", "text", "datetime", "boolean", "target",
    "identifier_ignore",
)
TASKS = ("classification", "regression")
TARGET_TYPES = (
    "binary_01", "binary_numeric", "binary_text_labels", "binary_boolean",
    "multiclass_int_labels", "multiclass_text_labels", "high_cardinality_text",
    "numeric_continuous", "unknown_type",
)

# Words looked for inside lower-cased column names.
TARGET_NAME_WORDS = ("target", "label", "class", "outcome", "output", "result", "y", "response")
IDENTIFIER_NAME_WORDS = ("id", "uuid", "key", "index")
NUMERIC_NAME_WORDS = (
    "age", "year", "count", "number", "num", "score", "rating", "rank",
    "bedroom", "bathroom", "room", "floor", "garage", "space", "feet",
    "size", "area", "distance", "mile", "meter", "inch", "height", "width",
    "length", "depth", "weight", "price", "cost", "value", "amount",
    "percent", "rate", "level", "grade", "quality",
)
DERIVED_FROM_TARGET_WORDS = ("price", "value", "cost", "worth", "total", "amount")
FEATURE_CATEGORY_WORDS = {
    "demographic": ("age", "gender", "sex", "race", "ethnicity", "marital", "education"),
    "financial": ("income", "salary", "price", "cost", "amount", "balance", "payment"),
    "behavioral": ("frequency", "count", "usage", "activity", "behavior", "visits"),
    "geographic": ("location", "city", "state", "country", "region", "zip", "postal"),
    "temporal": ("date", "time", "year", "month", "day", "duration", "since"),
    "product": ("product", "service", "category", "type", "brand", "model"),
}

# Most classes that a model comparison takes on.
MOST_CLASSES = 2_000

# Cells of a CSV file that count as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)

# Text booleans.
TRUE_WORDS = ("yes", "y", "true", "1", "on", "enabled")
FALSE_WORDS = ("no", "n", "false", "0", "off", "disabled")

# Fill values.
MISSING_TARGET = "_MISSING_TARGET_"
MISSING_TEXT = "_MISSING_"
UNKNOWN_TEXT = "_UNKNOWN_"
MISSING_DATE = "1900-01-01"

# Thresholds.
MAX_CATEGORY_LEVELS = 20        # text with at most this many values is categorical
MIN_NUMERIC_SHARE = 0.8         # text is numeric when this share of rows parses
MAX_LABEL_LEVELS = 10           # integers with at most this many values are labels
TEXT_DISTINCT_RATIO = 0.8       # text whose values are mostly different is free text
MISSING_SHARE_ALLOWED = 0.3
CATEGORY_LEVELS_ALLOWED = 50
BETWEEN_MOSTLY = 0.95
GATE_SUCCESS_RATE = 0.90
GATE_STRICT_RATE = 0.95
TIER_HIGH = 0.7
TIER_MEDIUM = 0.3
TFIDF_TERMS = 50
EXPLAIN_ROWS = 500
MIN_TRAINING_ROWS = 30
SUGGESTION_CONFIDENCE = 0.87
INTERVAL_SHARE = 0.1

# Run stages in order, and the progress shown for each.
STAGES = ("ingest", "schema", "validation", "prep", "automl", "explain")
STAGE_PROGRESS = {
    "ingest": 0, "schema": 10, "validation": 30, "prep": 50, "automl": 70,
    "explain": 90, "completed": 100, "failed": 100,
}

# Expectation names.
EXP_COLUMNS_ORDERED = "expect_table_columns_to_match_ordered_list"
EXP_ROW_COUNT = "expect_table_row_count_to_be_between"
EXP_COLUMN_EXISTS = "expect_column_to_exist"
EXP_TYPE = "expect_column_values_to_be_of_type"
EXP_NOT_NULL = "expect_column_values_to_not_be_null"
EXP_IN_SET = "expect_column_values_to_be_in_set"
EXP_IN_TYPE_LIST = "expect_column_values_to_be_in_type_list"
EXP_DISTINCT_SET = "expect_column_distinct_values_to_equal_set"
EXP_UNIQUE_COUNT = "expect_column_unique_value_count_to_be_between"
EXP_BETWEEN = "expect_column_values_to_be_between"
CRITICAL_EXPECTATIONS = (EXP_COLUMN_EXISTS, EXP_COLUMNS_ORDERED, EXP_TYPE)
EXPECTATIONS_EVALUATED_IN_COMPAT = (
    EXP_COLUMNS_ORDERED, EXP_ROW_COUNT, EXP_COLUMN_EXISTS, EXP_TYPE, EXP_NOT_NULL,
)

# English stop words, the list that Spark's StopWordsRemover ships.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd",
    "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've", "you've",
    "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's",
    "how's", "let's", "ought", "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
)
