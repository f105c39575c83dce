"""Small word lists of our own, of words that the synthetic tables hold."""

INSULTS = ("scum", "idiot", "trash", "clown", "moron", "worthless", "stupid", "pathetic", "disgusting", "vile")
#: word, valence, arousal
VALUED = [(w, -0.8, 0.7) for w in INSULTS] + [("the", 0.1, 0.2), ("with", 0.2, 0.3), ("and", 0.0, 0.1), ("that", -0.1, 0.4), ("threat", -0.7, 0.8), ("are", 0.3, 0.2)]
STEMS = ("wort", "idio", "disg", "ther", "anth", "ou")
ANCHORS = ("the", "that")
AI_PATTERNS = (r"\bof the\b", r"\bthe and\b", r"\bmoreover\b", r"\bit'?s worth\b", r"\bthat are\b", r"\bdelve\b")
HEDGES = (r"\bperhaps\b", r"\bis the\b", r"\bare of\b", r"\bgenerally speaking\b", r"\bto with\b")
FINANCE = ("the", "of", "is")
