"""Word search with lexicon, negation window and exclusions, and vector search."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as english

#: The vocabulary of the finished rules.
GOOD_WORDS = ("good", "well", "great", "excellent", "outstanding", "fine", "cooperative", "respectful", "polite", "courteous", "compliant", "exemplary", "stellar", "solid", "positive", "commendable")
GOOD_PHRASES = ("no issues", "no problems", "no incidents", "no trouble", "squared away", "model inmate", "pleasure to supervise", "zero write-ups", "without complaint", "10/10", "a+", "stayed out of trouble", "helped staff", "volunteered", "de-escalated")
NEGATORS = ("not", "no", "never", "n't", "hardly", "nothing")
NEGATING_PHRASES = ("anything but", "far from", "no longer")
EXCLUDE_TOKENS = ("goods", "goodman", "goode")
EXCLUDE_PHRASES = ("good time", "good conduct time")


def lexicon(
    c: Column, words: Sequence[str], negators: Sequence[str] = (), window: int = 0, exclude: Sequence[str] = (), lemmas: dict[str, str] | None = None,
    phrases: Sequence[str] = (), negating_phrases: Sequence[str] = (), exclude_phrases: Sequence[str] = (), by_rule: bool = False,
) -> Column:
    """True where a word or a phrase is found that nothing in the window of words before it negates.

    Tokens are those of ``words.tokens``, signs included, which count in the windows. A word counts by its lemma, from
    ``lemmas`` or, with ``by_rule``, else by the rules of ``words.lemma``, unless it is one of ``exclude`` or an excluded phrase begins with it; skipped words stay
    in the windows of others. Of a phrase, the first occurrence outside the excluded phrases counts; the words before
    it are split at white space.
    """
    bare = F.lower(c)
    for p in exclude_phrases:
        bare = F.regexp_replace(bare, rf"\b{re.escape(p)}\b", " ")
    table = F.create_map(*[F.lit(x) for kv in lemmas.items() for x in kv]) if lemmas else None
    ruled = english.lemma if by_rule else lambda w: w
    lemma = lambda w: F.coalesce(F.try_element_at(table, w), ruled(w)) if lemmas else ruled(w)

    def denied(before: Column) -> Column:
        found = [F.arrays_overlap(before, F.array(*[F.lit(n) for n in negators]))] if negators else []
        found += [F.contains(F.array_join(before, " "), F.lit(p)) for p in negating_phrases]
        return reduce(or_, found)

    negates = bool(window and (negators or negating_phrases))

    def hit(t: Column, w: Column, i: Column) -> Column:
        ok = lemma(w).isin(*words)
        if exclude:
            ok = ok & ~w.isin(*exclude)
        for p in exclude_phrases:
            ok = ok & (F.array_join(F.slice(t, i + 1, len(p.split())), " ") != p)
        if negates:
            start = F.greatest(i - window, F.lit(0))
            ok = ok & ~denied(F.slice(t, start + 1, i - start))
        return F.struct(ok.alias("ok"))

    def said(text: Column, p: str) -> Column:
        ok = F.contains(text, F.lit(p))
        if negates:
            before = F.filter(F.split(F.substring_index(text, p, 1), r"\s+"), lambda w: w != "")
            ok = ok & F.exists(F.array(before), lambda b: ~denied(F.slice(b, F.greatest(F.size(b) - window, F.lit(0)) + 1, F.least(F.size(b), F.lit(window)))))
        return ok

    # tokens and text are bound once, as the variable of a function over an array of one
    found = [F.exists(F.array(english.tokens(c)), lambda t: F.exists(F.transform(t, lambda w, i: hit(t, w, i)), lambda x: x["ok"]))] if words else []
    if phrases:
        found.append(F.exists(F.array(bare), lambda text: reduce(or_, [said(text, p) for p in phrases])))
    return reduce(or_, found, F.when(c.isNotNull(), False))


def best_rules(c: Column, lemmas: dict[str, str] | None = None) -> Column:
    """The finished rules: the whole vocabulary by lemma, negated within three tokens, without the exclusions."""
    return lexicon(c, GOOD_WORDS, NEGATORS, 3, EXCLUDE_TOKENS, lemmas, GOOD_PHRASES, NEGATING_PHRASES, EXCLUDE_PHRASES, by_rule=True)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def semantic_topk(df: DataFrame, query: DataFrame, id_col: str, vec_col: str, k: int, once: str | None = None) -> DataFrame:
    """The k rows nearest by cosine to the single vector of the one-row frame ``query`` (column q), ties by id.

    The order is that of the exact value, which is shown with six places. Of rows with equal ``once`` (a text, say)
    only that of the smallest id counts.
    """
    near = df.join(F.broadcast(query.limit(1)), how="inner").withColumn("similarity", cosine(F.col(vec_col), F.col("q")))
    if once:
        near = near.groupBy(once).agg(F.min_by("similarity", id_col).alias("similarity"), F.min(id_col).alias(id_col))
    best = near.select(id_col, "similarity").orderBy(F.desc("similarity"), id_col).limit(k)
    return best.withColumn("similarity", F.round("similarity", 6))
