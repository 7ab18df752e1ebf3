"""Text as the index reads it: tokens, plural folding, stopwords, edit neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between tokens: whatever is neither alphabetic nor numeric.
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]+"

#: Function words that carry no topic; dropped from questions only.
STOPWORDS = (
    "a about an and any are as at be been but by can did do does for from get give had has have how i if in "
    "into is it its make may me my no not of on or our out over should so some than that the their them then "
    "there these they this to up us use used was we were what when where which who why will with would you your"
).split()


def fold(token: Column) -> Column:
    """A lower-case word and its plural to one form. Lengths are in bytes."""
    size = F.octet_length(token)

    def without(n: int) -> Column:
        return F.substring(token, F.lit(1), F.char_length(token) - n)

    return (
        F.when((size > 4) & token.endswith("ies"), F.concat(without(3), F.lit("y")))
        .when((size > 4) & token.endswith("sses"), without(2))
        .when(
            (size > 3)
            & token.endswith("s")
            & ~token.endswith("ss")
            & ~token.endswith("us")
            & ~token.endswith("is"),
            without(1),
        )
        .otherwise(token)
    )


def raw_tokens(text: Column) -> Column:
    """The words of a text as written; null for null."""
    return F.filter(F.split(text, NOT_ALNUM), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Lower-case, plural-folded words in order; null for null."""
    return F.transform(raw_tokens(text), lambda t: fold(F.lower(t)))


def fold_py(token: str) -> str:
    """``fold`` for Python code on small inputs."""
    size = len(token.encode())
    if size > 4 and token.endswith("ies"):
        return token[:-3] + "y"
    if size > 4 and token.endswith("sses"):
        return token[:-2]
    if size > 3 and token.endswith("s") and not token.endswith(("ss", "us", "is")):
        return token[:-1]
    return token


def folded_stopwords() -> list[str]:
    return sorted({fold_py(w) for w in STOPWORDS})
