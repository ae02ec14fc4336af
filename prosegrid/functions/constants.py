"""Fixed values of the scoring model: word lists, coefficients and thresholds."""

# Fixed values: (feature, mean, scale, coefficient), in the model's order.
FEATURES = (
    ("mean_sentence_words", 19.169892, 4.611334, 0.086475),
    ("sentence_length_cv", 0.373234, 0.194613, -0.177601),
    ("short_sentence_ratio", 0.100407, 0.167607, 0.191876),
    ("long_sentence_ratio", 0.146019, 0.159946, -0.221335),
    ("mean_word_length", 5.544774, 0.561957, 1.115961),
    ("repeated_word_ratio", 0.32609, 0.064824, 0.306664),
    ("hapax_ratio", 0.777079, 0.053952, -0.073394),
    ("stopword_ratio", 0.332118, 0.057333, -0.485904),
    ("first_person_ratio", 0.00435, 0.012932, 0.084387),
    ("contraction_ratio", 0.006719, 0.009922, 0.160147),
    ("numeric_token_ratio", 0.012439, 0.026226, -0.185194),
    ("comma_per_sentence", 1.202097, 0.576623, -0.152215),
    ("semicolon_colon_per_sentence", 0.086143, 0.162873, 0.397865),
    ("parenthetical_dash_per_sentence", 0.231967, 0.356152, -0.90273),
    ("transition_opening_ratio", 0.108971, 0.128201, -0.032839),
    ("stock_phrase_per_sentence", 0.011924, 0.042799, 0.198899),
    ("nominalization_ratio", 0.057726, 0.031087, 0.136819),
    ("adjacent_sentence_overlap", 0.036546, 0.026588, 0.048363),
    ("repeated_opener_ratio", 0.024099, 0.060796, -0.131793),
    ("proper_noun_ratio", 0.05519, 0.053052, 0.140574),
    ("passive_construction_ratio", 0.169715, 0.191046, -0.412623),
    ("hedge_ratio", 0.009715, 0.010816, 0.124254),
)
# Fixed values.
INTERCEPT = 0.041724
THRESHOLD = 0.861392
LONG_WORD = 10
LONG_WORD_BOUND = 0.267717
LEXICAL_BOUND = 0.817116
LEXICAL = ("mean_word_length", "stopword_ratio", "nominalization_ratio")
LEAST_WORDS, MOST_WORDS = 300, 30000
REVIEW, HIGH = 20, 50

# Word lists.
STOPWORDS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or our she that "
    "the their they this to was we were which with you"
).split()
FIRST_PERSON = "i me my mine we us our ours".split()
HEDGES = "appears can could generally likely may might often perhaps possibly seems suggests typically".split()
ENGLISH = (
    "a an and are as at be been by for from had has have in is it of on or that the their this to was were which with"
).split()
NON_ENGLISH = (
    "adalah atau dalam dan dari dengan ini pada untuk yang de del el en la las los para por que una une des dans les pour"
).split()
ABBREVIATIONS = "approx. dr. e.g. etc. fig. i.e. jr. mr. mrs. ms. no. prof. sr. st. vs.".split()
MAY_END = "approx. etc. fig. no. vs.".split()

# Patterns that Java, RE2 and Python's regex read alike.
TOKEN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
WORD = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)?|\p{N}+(?:[.,]\p{N}+)*"
EDIT_TOKEN = r"[\p{L}\p{M}\p{N}]+"
SENTENCE = r"""[^.!?]+(?:[.!?]+["'”’\])}]*|\z)"""
OPENINGS = (
    "additionally|consequently|furthermore|however|in conclusion|in contrast|in summary|moreover|nevertheless|"
    "on the other hand|overall|therefore|thus"
)
STOCK = (
    r"it is (?:important|essential|crucial) to (?:note|recognize|understand)",
    r"plays? (?:a|an) (?:important|key|crucial|vital|significant) role",
    r"in today['’]s (?:world|society|digital age)",
    r"a wide range of",
    r"delve into",
    r"multifaceted",
    r"underscores? the importance",
    r"it is evident that",
)
SUFFIX = "(?:ance|ence|ism|ity|ment|ness|sion|tion)$"
PASSIVE = r"(?:am|are|be|been|being|is|was|were)\s+(?:\w+ly\s+)?\w+(?:ed|en)"
LABELS = (
    r"name|student\s+id|program(?:\s+studi)?|title|type\s+of\s+submission|signature|date|faculty|university|"
    r"place\s+of\s+approval|npm|tanda\s+tangan|tahun\s+akademik|keywords?|kata\s+kunci"
)
REFERENCES = (
    r"^\s*(?:\d{1,4}\s+)?(?:references?|referencias|referensi|références|bibliography|works\s+cited|reference\s+list|"
    r"daftar\s+pustaka|literaturverzeichnis)\s*:?\s*$"
)
LIST_ITEM = r"^\s*(?:[-*•▪◦]|\d{1,3}[.)]|[a-z][.)])\s+"
PAGE_NUMBER = r"^\s*(?:page\s+)?(?:\d{1,4}|[ivxlcdm]{1,10})(?:\s+(?:of|/|-|–)\s*(?:\d{1,4}|[ivxlcdm]{1,10}))?\s*$"
CONTENTS = r"\.{3,}\s*(?:\d{1,4}|[ivxlcdm]{1,10})\s*$"
CODE = r"^\s*(?:```|~~~|(?:export\s+)?(?:async\s+)?function\b|(?:const|let|var|class|interface|type)\s+[\w$]+\s*(?:[=:<{(]))"
ADDRESS = r"^\s*(?:https?://|www\.|doi\s*:|submission\s+id\b|file\s+name\b)"
CITATION = r"\((?:[^()]{0,100}\b(?:19|20)\d{2}[a-z]?[^()]*)\)|\[(?:\s*\d{1,3}\s*[,;–-]?\s*)+\]"
