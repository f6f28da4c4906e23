"""Fixed values of the evaluated workflow, stated together.

These must equal the original behaviour for results to agree; every module
takes them as defaults and every one can be overridden by a parameter.
"""

# Fixed values
THRESHOLD = 0.5                 # probability at or above which a study is relevant
FUZZY_THRESHOLD = 90            # token-sort ratio at or above which two titles match
MAX_FULLTEXT_CHARS = 120_000    # full text is cut to this many characters in the screening prompt
CHECKPOINT_EVERY_TITLE_ABSTRACT = 100   # rows between progress files, title/abstract screening
CHECKPOINT_EVERY_FULL_TEXT = 20         # rows between progress files, full-text screening
RATE_LIMIT_MARKERS = ("429", "rate_limit")      # error text → rate_limit ("429" case-sensitive)
NETWORK_MARKERS = ("timeout", "connection")     # error text (lower-cased) → network
RETRYABLE_CLASSES = ("rate_limit", "network")
