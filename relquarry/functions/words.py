"""Frequent words of four languages, by word class; they serve as stop words, too."""


def _words(*classes: str) -> tuple[str, ...]:
    return tuple(sorted({w for c in classes for w in c.split()}))


ENGLISH = _words(
    "the a an",  # articles
    "of in on at to for by with into up",  # prepositions and particles
    "and or but if as then that such not no only most all",  # conjunctions, negation, quantity
    "it they their this these who there",  # pronouns
    "is are was be will",  # verbs
    "r",
)
GERMAN = _words(
    "dem den der des das die ein eine einem einen einer eines",  # articles
    "ich er es du wir man sich euer unser mein dein",  # pronouns
    "diese dieser dieses jene jener jenes jede jedem jeden jeder jedes manche manchem manchen mancher manches",
    "welche welcher welches einige einigem einigen einiger einiges etliche etlichem etlichen etlicher etliches",
    "alle aller alles kein keine keinem keinen ihr ihre eurer sein seine seiner deren dessen wessen",
    "an am auf aus bei bis durch für gegen im in mit nach über um unter vom von vor zu zum zur zwischen",  # prepositions
    "aber als auch daß dann oder so und wenn wie schon noch nur nicht mehr immer wieder zwei",  # conjunctions, adverbs
    "habe haben hat hatte ist kann können sei sie sind soll war werden wird worden wurde",  # verbs
)
FRENCH = _words("la le les un une du des", "ces cet cette on", "et de es")
SPANISH = _words("el la lo los las un una unas unos del al", "a de en", "y e es")
LISTS = {"none": (), "english": ENGLISH, "german": GERMAN, "french": FRENCH, "spanish": SPANISH}


def word_list(words) -> tuple[str, ...]:
    """A named list, or the words given."""
    if words is None:
        return ()
    return LISTS[words.lower()] if isinstance(words, str) else tuple(words)
