"""Fixed values for the SQL of queries, written down apart from those that the Spark side uses."""

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
LEXICAL = ("mean_word_length", "stopword_ratio", "nominalization_ratio")

# Word lists.
STOPWORDS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or our "
    "she that the their they this to was we were which with you"
).split()
FIRST_PERSON = (
    "i me my mine we us our ours"
).split()
HEDGES = (
    "appears can could generally likely may might often perhaps possibly seems suggests typically"
).split()
ENGLISH = (
    "a an and are as at be been by for from had has have in is it of on or that the their this to was "
    "were which with"
).split()
NON_ENGLISH = (
    "adalah atau dalam dan dari dengan ini pada untuk yang de del el en la las los para por que una une "
    "des dans les pour"
).split()
ABSTRACT = (
    "adaptation advancement approach aspect challenge complexity comprehensive consideration context "
    "crucial development dynamic effectiveness efficiency enhancement essential evolution facilitation "
    "factor framework holistic implementation importance improvement innovation innovative integration "
    "landscape methodology multifaceted optimization outcome paradigm perspective pivotal potential "
    "process progress quality robust significance significant solution strategy transformation "
    "utilization value"
).split()

# Patterns; \b is an edge of ASCII words here.
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
PHRASES = (
    r"\bin today['’]s (?:rapidly |ever[- ]?)?(?:evolving |changing )?(?:world|landscape)\b",
    r"\bit (?:is|remains) important to (?:note|recognize|understand)\b",
    r"\bit should be noted that\b",
    r"\bplays? a (?:crucial|vital|pivotal|significant) role\b",
    r"\ba (?:wide|broad|diverse) range of\b",
    r"\bit is (?:clear|evident|apparent) that\b",
    r"\bthis (?:highlights|underscores|demonstrates) the importance of\b",
    r"\bin conclusion\b",
    r"\bwhen it comes to\b",
    r"\bdelve(?:s|d)? into\b",
    r"\bnavigat(?:e|es|ing) the complexities\b",
    r"\b(?:rapidly|ever)[- ]evolving\b",
    r"\bholistic approach\b",
    r"\brobust framework\b",
    r"\bseamless(?:ly)?\b",
    r"\bmultifaceted\b",
    r"\ba testament to\b",
    r"\brich tapestry\b",
    r"\bnot only\b[^.!?]{0,90}\bbut also\b",
)
TRANSITION = (
    r"^\s*(however|moreover|furthermore|additionally|consequently|therefore|thus|in addition|on the other hand|in co"
    r"nclusion|ultimately|overall|first(?:ly)?|second(?:ly)?|finally)\b[\s,:;—-]*"
)
NOMINAL = r"(?:tion|sion|ment|ness|ance|ence|ity|ization|isation|ship|acy)$"
CONCRETE = r"""\d|["“”]|\b(?:I|we|my|our|me|us)\b"""
