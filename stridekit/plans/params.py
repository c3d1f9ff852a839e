"""Parameters of the registered queries (ours, not fixed rules).

The reference's own keyword lists hardly occur in the test text (an invented
vocabulary with real function words), so the registered queries pass keyword
tables made of words that do occur. Operators take any table.
"""

from ..functions.keywords import CLASS_ORDER

# (class, weight, keyword): weight 3 = primary, 1 = secondary; substring match.
DEMO_KEYWORDS = [
    ("TITAN", 3, "the"), ("TITAN", 1, "and"), ("TITAN", 1, "was"),
    ("ORACLE", 3, "with"), ("ORACLE", 1, "this"), ("ORACLE", 1, "that"),
    ("PHANTOM", 3, "from"), ("PHANTOM", 1, "for"), ("PHANTOM", 1, "are"),
    ("SAGE", 3, " la "), ("SAGE", 1, " le "), ("SAGE", 1, " des "),
    ("MUSE", 3, " der "), ("MUSE", 1, " und "), ("MUSE", 1, " die "),
    ("EMPIRE", 3, " que "), ("EMPIRE", 1, " los "), ("EMPIRE", 1, " las "),
    ("GG", 3, "ing"), ("GG", 1, "ion"), ("GG", 1, "ed "),
]

# Any-keyword filter words.
FILTER_KEYWORDS = ["with", "from", "pour", "und"]

# Cascade stages: (class, keywords, quota), in priority order.
CASCADE_STAGES = [
    ("PHANTOM", ["from", "pour"], 100),
    ("TITAN", ["the", "les"], 60),
    ("SAGE", ["with", "und"], 60),
]

# Source name -> class: src0..src13 map onto the classes in order; others unmapped.
SOURCE_CLASS = {f"src{i}": CLASS_ORDER[i % len(CLASS_ORDER)] for i in range(14)}

# Persona system text per class.
PERSONAS = {c: f"You are the {c} coach." for c in CLASS_ORDER}

SYSTEM_TEXT = "You are a helpful coach."
SEED = 42

# Replay of late events: of every 10 events one arrives 1 to 3 days late; micro-batches of 8 days of arrival.
LATE_EVERY, LATE_DAYS, BATCH_DAYS = 10, 3, 8

# Event time that the feature stream waits for late rows.
FEATURE_DELAY_DAYS = 2

# Things people say, added to the tables' texts in turn (the invented vocabulary has none of
# the lexicon's or the router's words): both sides of the lexicon, once and several times, ties,
# words of every route, and nothing.
SAID = [
    "", "i want to give up", "hopeless and stuck and exhausted", "crushed it today", "proud and unstoppable and hyped", "stuck but proud",
    "how much xp do i earn", "can i switch my build", "hey whats up", "so tired", "my daily streak",
]
