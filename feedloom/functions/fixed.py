"""Fixed values.

Everything in this file must read exactly like this for results to be right:
labels and text a reader of the portal sees, the request a model is sent, limits,
and the markers an error message is recognised by.
"""

# Limits of a harvest run.
RECENT_HOURS = 24
ARTICLES_PER_FEED = 2
CONTENT_CHARS = 2500

# Limits of the reading side.
LATEST_ARTICLES = 20
DASHBOARD_DAYS = 7

# Defaults.
UNKNOWN_SOURCE = "Unknown Source"
OTHER_CATEGORY = "Other"
MODEL = "llama3:latest"

# Keys of a model answer.
ANSWER_KEYS = ("title_en", "title_pt", "summary_en", "summary_pt")

# Messages that mean "this URL is already there".
DUPLICATE_MARKERS = ("duplicate key value", "unique constraint")

# Display text by language.
STATUS_LABEL = {"en": "Published", "pt": "Publicado"}
WEEKDAYS = {
    "en": ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"),
    "pt": ("Dom", "Seg", "Ter", "Qua", "Qui", "Sex", "Sab"),
}
MONTHS_SHORT_PT = (
    "jan.", "fev.", "mar.", "abr.", "mai.", "jun.",
    "jul.", "ago.", "set.", "out.", "nov.", "dez.",
)
MONTHS_LONG_PT = (
    "janeiro", "fevereiro", "março", "abril", "maio", "junho",
    "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
)

# Names in RFC 822 dates: months, and zones with their offsets.
MONTHS_RFC_822 = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
)
ZONE_OFFSETS = {
    "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "AST": "-04:00", "ADT": "-03:00", "AT": "-04:00", "ET": "-05:00",
    "CT": "-06:00", "MT": "-07:00", "PT": "-08:00", "MET": "+01:00", "MEST": "+02:00",
}

# Request text around an article.
PROMPT_HEAD = """
You are a highly professional technology journalist and SEO expert.
Read the following news article excerpt.

Create a highly engaging, original, SEO-friendly summary in English (about 2 paragraphs).
Then, provide a high-quality, localized translation of that summary into Brazilian Portuguese.
The tone in both languages must be similar, professional, and journalistic.

CRITICAL RULES:
- NEVER use emojis anywhere in your response. Not a single one.
- Output ONLY valid JSON. Do not use markdown blocks like ```json.
- The JSON structure MUST strictly follow this exact format:
{
    "title_en": "SEO rewritten english title",
    "title_pt": "Translated portuguese title",
    "summary_en": "Your original English summary...",
    "summary_pt": "Your translated Portuguese summary..."
}

Article Excerpt:
"""
PROMPT_TAIL = "\n"
