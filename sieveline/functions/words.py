"""Tokens and lemmas of English text, as columns: punctuation counts as tokens, endings follow a table of rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token, the first kind that fits: the n't and other ends of contracted words, numbers, words, runs of dots or dashes, any other sign.
_TOKEN = r"n['’]t(?![\p{L}\d])|['’](?:s|re|ve|ll|d|m)(?![\p{L}\d])|\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?(?![\p{L}\d])|[\p{L}\p{M}\d]+(?:['’]\p{L}{3,})?\+?|\.{2,}|-{2,}|\S"

#: Forms that no ending explains, by lemma.
IRREGULAR = {
    "be": "am is are was were been being 're 'm", "have": "has had having 've", "do": "does did done doing", "not": "n't", "will": "wo 'll", "can": "ca", "would": "'d",
    "good": "better best", "bad": "worse worst", "little": "less least", "much": "more most", "far": "further furthest farther farthest",
    "great": "greater greatest", "fine": "finer finest", "polite": "politer politest", "solid": "solider solidest",
    "go": "went gone goes", "get": "got gotten getting", "make": "made making", "say": "said", "take": "took taken taking", "come": "came coming", "give": "gave given giving", "see": "saw seen",
    "know": "knew known", "think": "thought", "tell": "told", "find": "found", "leave": "left leaving", "keep": "kept", "hold": "held", "bring": "brought", "write": "wrote written writing",
    "stand": "stood", "hear": "heard", "mean": "meant", "meet": "met", "run": "ran", "pay": "paid", "sit": "sat", "speak": "spoke spoken", "lead": "led", "grow": "grew grown", "lose": "lost losing",
    "fall": "fell fallen", "send": "sent", "build": "built", "understand": "understood", "break": "broke broken", "spend": "spent", "draw": "drew drawn", "drive": "drove driven driving", "buy": "bought",
    "wear": "wore worn", "choose": "chose chosen choosing", "begin": "began begun", "eat": "ate eaten", "fight": "fought", "throw": "threw thrown", "teach": "taught", "sleep": "slept", "steal": "stole stolen", "feel": "felt",
    "man": "men", "woman": "women", "child": "children", "cookie": "cookies", "movie": "movies", "foot": "feet", "tooth": "teeth", "mouse": "mice", "life": "lives", "wife": "wives", "knife": "knives", "thief": "thieves", "half": "halves",
    "use": "used using uses", "help": "helped", "behave": "behaved behaving", "refuse": "refused refusing", "argue": "argued arguing", "volunteer": "volunteered volunteering", "offer": "offered offering", "visit": "visited visiting",
    "order": "ordered ordering", "deliver": "delivered delivering", "remember": "remembered remembering", "listen": "listened listening", "follow": "followed following", "answer": "answered answering",
}

#: Words whose ending is none.
UNCHANGED = "this his its us yes always perhaps as news series less process pass class miss business illness during thing nothing something anything everything morning evening bring sing ring king spring string need seed feed speed indeed bed red bleed weed exceed wing"

#: Fixed values: (form, lemma) of words that end in -s, -ed or -ing; the first form that fits.
_RULES = (
    (r"^(.{2,})ies$", r"$1y"), (r"^(.+(?:ss|sh|ch|x|zz))es$", r"$1"), (r"^(.{2,}o)es$", r"$1"), (r"^(.+[^siu'])s$", r"$1"),
    (r"^(.{2,})ied$", r"$1y"), (r"^(.+ee)d$", r"$1"), (r"^(.*uot)(?:ed|ing)$", r"$1e"),
    (r"^(.*[aeiouy].*(?:ll|ss|ff|zz))(?:ed|ing)$", r"$1"),
    (r"^(.*[aeiouy].*([bdgmnprt]))\2(?:ed|ing)$", r"$1"),
    (r"^(.*[aeiouy].*(?:at|bl|iz|iv|uc|rs|ns|as|os|is|us|rc|nc|rg|ng|dg|[^aeiou]l|[aeiou]v|lv|rv))(?:ed|ing)$", r"$1e"),
    (r"^([^aeiouy]*[aeiou][^aeiouywx])(?:ed|ing)$", r"$1e"),
    (r"^(.*[aeiouy].*)(?:ed|ing)$", r"$1"),
)


def tokens(c: Column) -> Column:
    """Tokens in lower case; a contracted word is two of them, signs are tokens, white space is none."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), r"(?<=\p{L})(n['’]t)(?![\p{L}\d])", " $1"), F.lit(_TOKEN), F.lit(0))


def lemma(word: Column) -> Column:
    """The lemma of a token in lower case, by the table of irregular forms or the first rule that fits; else the word.

    Rules know endings, not parts of speech or a dictionary: 'left' is always 'leave', and a stem of an unusual shape may
    lack its last e. ``lexicon`` takes further lemmas by word.
    """
    known = {form: base for base, forms in IRREGULAR.items() for form in forms.split()} | {w: w for w in UNCHANGED.split()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ruled = word
    for form, base in reversed(_RULES):
        ruled = F.when(word.rlike(form), F.regexp_replace(word, form, base)).otherwise(ruled)
    # only a word with an ending is tried
    ruled = F.when(word.rlike(r"^\p{L}{2,}(?:s|ed|ing)$"), ruled).otherwise(word)
    return F.coalesce(F.try_element_at(table, F.regexp_replace(word, "’", "'")), ruled)


def lemmas(c: Column) -> Column:
    """(word, lemma) of each token, in order; null for a null text."""
    return F.transform(tokens(c), lambda w: F.struct(w.alias("word"), lemma(w).alias("lemma")))
