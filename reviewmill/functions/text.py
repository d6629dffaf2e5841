"""Text expressions: stripping, tokenizers, word lists, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists and patterns that results depend on.
EXPLORATION_STOP_WORDS = """
a al algo algunas algunos ante antes como con contra cual cuando de del desde
donde durante e el ella ellas ellos en entre era eran eres es esa esas ese esos
esta estaba estaban estamos estan estar estas este esto estos fue fueron ha
haber habia han hasta hay la las le les lo los mas me mi mis muy nos nosotros
o os otra otras otro otros para pero por porque que quien se ser si sobre son
su sus te tiene tienen todo todos tu tus un una unas uno unos usted ustedes y
ya él más mí qué quién cómo cuándo dónde está están había también
""".split()
VECTORIZER_STOP_WORDS = """
a al con de del el ella en es esta este ha la las lo los me mi mis para por que
se su sus un una unos unas y yo
""".split()
LINK_PATTERN = r"https?://\S+|www\.\S+"
WORD_PATTERN = r"[\p{L}\p{Nl}\p{No}]+"
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
SPACE_CLASS = r"[\s\x1c-\x1f]"

EDGE_SPACE = rf"(?U)^{SPACE_CLASS}+|{SPACE_CLASS}+\z"


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def text_or_null(text: Column) -> Column:
    """The text itself, or null where it is blank."""
    return F.when(~is_blank(text), text)


def fold_case(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def compose_unicode(text):
    """Canonical composition (NFC); Spark has no built-in for it."""
    return text.str.normalize("NFC")


def composed(text: Column) -> Column:
    """The text with composed accents; only texts with a combining mark are sent to the Arrow stage."""
    return F.coalesce(compose_unicode(F.when(text.rlike(r"\p{M}"), text)), text)


def words(text: Column, compose: bool = True) -> Column:
    """Exploration tokens: accents composed, folded case, links dropped, runs of letters."""
    value = F.coalesce(text, F.lit(""))
    if compose:
        value = composed(value)
    bare = F.regexp_replace(fold_case(value), LINK_PATTERN, " ")
    return F.regexp_extract_all(bare, F.lit(WORD_PATTERN), F.lit(0))


def terms(text: Column) -> Column:
    """Vectorizer tokens: lower case, word characters, two or more."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM_PATTERN), F.lit(0)
    )


def without(tokens: Column, stop_words: list[str]) -> Column:
    return F.filter(tokens, lambda token: ~token.isin(stop_words))


def kept_words(text: Column) -> Column:
    return without(words(text), EXPLORATION_STOP_WORDS)


def kept_terms(text: Column) -> Column:
    return without(terms(text), VECTORIZER_STOP_WORDS)


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs of an array of tokens, joined by one space."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda left, right: F.concat(left, F.lit(" "), right),
    )


def plain_wording(text: Column) -> Column:
    """Lower-case wording with every run of non-word characters as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\W+", " "))


def preview(text: Column, size: int) -> Column:
    """The first ``size`` characters, with an ellipsis when text was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def excerpt(text: Column, size: int) -> tuple[Column, Column]:
    """The first ``size`` characters and whether anything was cut."""
    return F.substring(text, 1, size), F.length(text) > size
