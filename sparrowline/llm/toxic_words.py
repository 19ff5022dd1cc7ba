"""Fixed values of the toxicity lexicon: lookalikes, stand-ins and common insults."""

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɑ": "a",
    "ı": "i", "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "η": "n", "ω": "w", "β": "b", "σ": "o",
}

#: Digits that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}

#: Signs that stand for letters inside words.
SIGNS = {"@": "a", "$": "s", "!": "i"}

#: Common insults, as a start where labels are few.
SEEDS = [
    "idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown",
    "imbecile", "bastard", "filth", "vermin", "retard",
]
