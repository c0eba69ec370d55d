"""Fixed values and defaults.

Everything under "FIXED VALUES" must stay byte-for-byte as written: the mode names, the
fallback rule, the prompt texts and the result formats are what a user of the original
application sees, so changing them changes results.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------
# FIXED VALUES (must equal the original application's behaviour)
# ---------------------------------------------------------------------------------------

# Model choices offered to the user, in menu order. Any other value falls back to the
# first one ("Clip-Clip"). "Blip-Text" is the text-only mode (one index, k rows, no fusion).
MODE_CHOICES = ["Clip-Clip", "Clip-STrans", "Clip-Blip", "Blip-Text"]
FALLBACK_MODE = "Clip-Clip"
TEXT_ONLY_MODE = "Blip-Text"

# Route of every mode: (model_choice, text_encoder, image_encoder, text_only).
# "clip" encodes the question into the image-text joint space; "sbert" and "blip" are
# text-only sentence encoders. Clip-Clip probes both indexes with the same clip vector.
MODE_ROUTES = [
    ("Clip-Clip", "clip", "clip", False),
    ("Clip-STrans", "sbert", "clip", False),
    ("Clip-Blip", "blip", "clip", False),
    ("Blip-Text", "sbert", None, True),
]

# Vector sets of every mode: (text space, image space). All hybrid modes share one image space.
MODE_SPACES = {
    "Clip-Clip": ("clip_text", "clip_image"),
    "Clip-STrans": ("sbert_text", "clip_image"),
    "Clip-Blip": ("blip_text", "clip_image"),
    "Blip-Text": ("amazon_text", None),
}

# Words that the catalog loader reads as a missing value.
MISSING_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
                 "NULL", "NaN", "n/a", "nan", "null"]

# Slicing response labels: the first line that contains the label (case-insensitive)
# carries the value; the label text "output_N:" is removed case-sensitively.
CONSTRAINTS_LABEL = "output_1"
KEYWORDS_LABEL = "output_2"

# Prompt texts (chat variant): system message for question slicing and for the answer.
QUERY_SLICING_SYSTEM_MSG = """
    You are a smart query parser for a multi-modal product search system.
    Your job is to split any incoming query into two precise outputs: (1) star/rating/price filters and (2) product search terms.

    Format your response as:
    output_1: Extract only information related to star ratings, customer reviews, or price (e.g., "stars above 4", "price under 50"). Summarize clearly and concisely.
    output_2: Extract the remaining product-related details (such as item type, material, finish, color, style, etc.) that are helpful for visual or embedding-based similarity search.
        Remove any duplicates or redundant phrases, and return the product name first with clean, lowercase, comma-separated keywords suitable for retrieval.
    """

RECOMMENDATION_SYSTEM_MSG = """
    You are an intelligent, frinedly, and energentic senior shopping assistant. A user is trying to find the right product based on their preferences.
    You will get the user query, user preferences, and the products retrieved by existing system based on visual and textual similarity to the user's preferences.
    Your goal is to provide the best recommendation, referencing following instructions.

    Instructions:
    1. Recommend 1-3 products from the retrieved products that best match the user's preferences. Prioritize products that match the user’s specific product description (e.g., design, style, material, target audience) in the query_text first.
    Only consider price and rating *after* verifying the product is relevant. Only recommend products provided from the "Retrieved Products" input.
    2. Only mention recommended products in your response. Do not mention products that were not selected.
    3. For each recommended product, provide:
      - Product Name
      - A short summary
      - Price
      - Rating
      - Pros and cons (if relevant)
      - Image URL (include as a standalone link to help user preview visually)
      - Product URL if available (optional, include only if exists)
    4. Be clear, friendly, energentic. Format recommendations in an easy-to-read way.
    5. Do not mention product numbers or internal labels (e.g., "Product 3").
    6. Provide a short final recommendation summary.

    Now generate your recommendation:
"""

# Prompt texts (agent variant): same roles, deeper indentation, another image line.
AGENT_SLICING_SYSTEM_MSG = """
            You are a smart query parser for a multi-modal product search system.
            Your job is to split any incoming query into two precise outputs: (1) star/rating/price filters and (2) product search terms.

            Format your response as:
            output_1: Extract only information related to star ratings, customer reviews, or price (e.g., "stars above 4", "price under 50"). Summarize clearly and concisely.
            output_2: Extract the remaining product-related details (such as item type, material, finish, color, style, etc.) that are helpful for visual or embedding-based similarity search.
                Remove any duplicates or redundant phrases, and return the product name first with clean, lowercase, comma-separated keywords suitable for retrieval.
            """

AGENT_RECOMMENDATION_SYSTEM_MSG = """
            You are an intelligent, frinedly, and energentic senior shopping assistant. A user is trying to find the right product based on their preferences.
            You will get the user query, user preferences, and the products retrieved by existing system based on visual and textual similarity to the user's preferences.
            Your goal is to provide the best recommendation, referencing following instructions.

            Instructions:
            1. Recommend 1-3 products from the retrieved products that best match the user's preferences. Prioritize products that match the user’s specific product description (e.g., design, style, material, target audience) in the query_text first.
            Only consider price and rating *after* verifying the product is relevant. Only recommend products provided from the "Retrieved Products" input.
            2. Only mention recommended products in your response. Do not mention products that were not selected.
            3. For each recommended product, provide:
            - Product Name
            - A short summary
            - Price
            - Rating
            - Pros and cons (if relevant)
            - show Product Image (in markdown)
            - Product URL if available (optional, include only if exists)
            4. Be clear, friendly, energentic. Format recommendations in an easy-to-read way.
            5. Do not mention product numbers or internal labels (e.g., "Product 3").
            6. Provide a short final recommendation summary.

            Now generate your recommendation:
        """

# Answer user message of the agent variant (12-space indented template).
AGENT_ANSWER_USER_PARTS = (
    '\n            Query: "',
    '"\n\n            User preferences (price/rating filters):\n            ',
    "\n\n            Retrieved Products:\n            ",
    "\n            ",
)

# Slicing user message: 'Query:\n"<question>"'.
SLICING_USER_PREFIX = 'Query:\n"'
SLICING_USER_SUFFIX = '"'

# Answer user message, pieces in order (8-space indented template of the chat variant):
# '\n        Query: "<q>"\n\n        User preferences (price/rating filters):\n        <c>'
# '\n\n        Retrieved Products:\n        <context>\n        '
ANSWER_USER_PARTS = (
    '\n        Query: "',
    '"\n\n        User preferences (price/rating filters):\n        ',
    "\n\n        Retrieved Products:\n        ",
    "\n        ",
)

# Product blocks are joined by a blank line; absent text columns print ''.
BLOCK_SEPARATOR = "\n\n"
MISSING_TEXT = ""

# Result card: '**<title>**  \nStore: <store>  \nPrice: $<price %.2f>  \nRating: <rating %.1f>/5'
CARD_PRICE_PATTERN = "0.00"
CARD_RATING_PATTERN = "0.0"

# Recommendations per answer: 1 to 3 products.
MAX_RECOMMENDATIONS = 3

# Defaults of the retrieval function and of the user interface.
DEFAULT_K = 5
DEFAULT_ALPHA = 0.5
UI_K = 10
UI_ALPHA = 0.15
DEFAULT_MODE = "Clip-STrans"
DEFAULT_MULTIPLIER = 20

# ---------------------------------------------------------------------------------------
# Our own defaults (not from the original application)
# ---------------------------------------------------------------------------------------

# Parity queries: k=10, multiplier=20 -> 200 rows per index, as the application runs them.
PARITY_K = 10
PARITY_MULTIPLIER = 20
PARITY_ALPHA = 0.15
ALPHA_GRID = [0.0, 0.15, 0.5, 1.0]

# Fixture adapter: every space is another slice (first element, length) of the supplied 64-dim embeddings. The
# joint-space text and image sets have one dimension, as one probe searches both.
SPACE_SLICES = {
    "clip_text": (17, 32),
    "sbert_text": (1, 24),
    "blip_text": (5, 40),
    "amazon_text": (9, 24),
    "clip_image": (33, 32),
}
# Encoder outputs of a question "more like this product".
ENCODER_SLICES = {"clip": (33, 32), "sbert": (1, 24), "blip": (5, 40)}
EMBEDDING_DIM = 64
IMAGE_URL_PREFIX = "https://img.invalid/"
IMAGE_URL_SUFFIX = ".jpg"

# Stand-in text encoders (dimension) and what each vector set is made of when products are encoded from their texts.
TEXT_ENCODERS = {"clip": 32, "sbert": 24, "blip": 40}
TEXT_SPACES = {
    "clip_text": ("clip", ["title", "description", "store"]),
    "sbert_text": ("sbert", ["title", "description", "store"]),
    "blip_text": ("blip", ["title", "description", "store"]),
    "amazon_text": ("sbert", ["title", "store"]),
    "clip_image": ("clip", ["description"]),
}

# Hashing text encoder: number of buckets of the hashed bag-of-words vector.
HASH_DIM = 256
