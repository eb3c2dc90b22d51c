"""Text functions over columns. Everything but folding, unescaping and title case stays in the JVM."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
SPECIAL_PHRASES = ["x ray", "x-ray", "t cell", "t-cell", "b cell", "b-cell", "3d printing", "5g network", "e-commerce", "a/b testing", "c++", "r", "k-means", "n-gram", "p value", "q factor", "s wave", "v chip", "h-index", "i beam", "o ring", "z score"]
BAD_FIRST_WORDS = ["and", "of", "for", "in", "to"]
BAD_WORDS = ["with", "on", "at", "from", "by", "about", "as", "into", "like", "through", "after", "over", "between", "out", "against", "during", "without", "before", "under", "around", "among", "but", "or", "yet", "so", "nor", "because", "although", "since", "unless", "while", "where", "if"]
CONTRACTIONS = {"'s": "is", "n't": "not", "'m": "am", "'re": "are", "'ve": "have", "'ll": "will"}
SYMBOL_PHRASES = [
    "x-ray", "e-mail", "wi-fi", "e-commerce", "e-learning", "e-book", "i-beam", "t-shirt", "u-bolt", "v-belt", "z-wave", "k-means", "n-gram", "p-value", "t-test", "f-score", "c-section",
    "h-bridge", "q-factor", "s-curve", "y-axis", "b-tree", "k-nearest neighbor", "l-system", "r-value", "g-force", "o-ring", "u-value", "t-junction", "v-chip", "x-axis", "gamma-ray",
    "beta-carotene", "alpha-particle", "omega-3", "micro-controller", "nano-technology", "bio-fuel", "cryo-surgery", "photo-voltaic", "thermo-electric", "electro-magnetic", "hydro-electric",
    "piezo-electric", "magneto-resistive", "opto-electronic", "ferro-magnetic", "quasi-periodic", "semi-conductor", "ultra-sonic", "infra-red", "ultra-violet", "multi-layer", "co-processor",
    "sub-system", "inter-connect", "cross-platform", "self-assembly", "non-linear", "anti-aliasing", "pre-processing", "post-processing", "real-time", "feed-forward", "back-propagation",
    "machine-learning", "deep-learning", "blockchain",
]
ATTACHED = ["'s", "n't", "'m", "'re", "'ve", "'ll"]
#: The references that stored pages are read with, where they are finished; that of the ampersand is the last, so that none is resolved twice.
REFERENCES = {"&nbsp;": "\xa0", "&copy;": "\xa9", "&middot;": "\xb7", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
#: Punctuation that becomes a blank, and brackets that get blanks around them.
BLANKED, SPACED = "!\"#$%&*+,-./:;=?@\\^_`|~", "[](){}<>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one blank, none at either end."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def clean_phrase(c: Column | str) -> Column:
    """Each word without one trailing ``39s`` or ``39``, then without a last token that looks like a patent number."""
    words = F.transform(F.split(_col(c), " ", -1), lambda w: F.regexp_replace(w, "39s?$", ""))
    return F.trim(F.regexp_replace(F.array_join(words, " "), r"\b[a-zA-Z]{2}[0-9]+[a-zA-Z0-9]*$", ""))


@F.pandas_udf(StringType())
def fold_ascii(texts: pd.Series) -> pd.Series:
    """ASCII only: compatibility decomposition, then what is left beyond ASCII goes. Null for null."""
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def clean_text(c: Column | str) -> Column:
    """Without URLs, as ASCII, punctuation but brackets and apostrophes as blanks, brackets set apart, blanks squeezed."""
    text = fold_ascii(F.regexp_replace(_col(c), r"http\S+", ""))
    text = F.translate(text, BLANKED, " " * len(BLANKED))
    return squeeze(F.regexp_replace(text, r"([\[\](){}<>])", " $1 "))


def expand_contractions(c: Column | str) -> Column:
    """Stand-alone contraction tokens of a blank-separated text as words: ``' s`` and ``'s`` are ``is``; a token split in two counts if its halves join to one."""
    text = F.concat(F.lit(" "), F.regexp_replace(_col(c), " ", "  "), F.lit(" "))
    text = F.regexp_replace(text, " '  [sS] ", " is ")
    for short, full in CONTRACTIONS.items():
        halves = "|".join([short, *(f"{short[:k]}  {short[k:]}" for k in range(1, len(short)))])
        text = F.regexp_replace(text, f" (?:{halves}) ", f" {full} ")
    return squeeze(text)


def attach_contractions(tokens: Column | str) -> Column:
    """Tokens (that hold no blanks) without empty ones, each of ATTACHED joined to the token before it; the first stays."""
    joined = F.array_join(F.filter(_col(tokens), lambda w: w != ""), " ")
    return F.filter(F.split(F.regexp_replace(joined, f" ({'|'.join(ATTACHED)})(?= |$)", "$1"), " ", -1), lambda w: w != "")


def strip_html(c: Column | str, references: dict[str, str] | None = None) -> Column:
    """Without tags (that don't cross a line feed) and with character references resolved: all that HTML knows, also unfinished ones, or only those given, one after the other."""
    bare = F.regexp_replace(_col(c), r"<[^\n]*?>", "")
    if references is None:
        return unescape_html(bare)
    for reference, character in references.items():
        bare = F.replace(bare, F.lit(reference), F.lit(character))
    return bare


@F.pandas_udf(StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    """Character references resolved; null for null."""
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)


def drop_parentheses(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\([^)]*\)", "")


def strip_urls(c: Column | str) -> Column:
    """Without URLs, blanks squeezed."""
    return squeeze(F.regexp_replace(_col(c), r"https?://\S+|www\.\S+", ""))


def strip_punctuation(c: Column | str, keep: list[str] = ()) -> Column:
    """Letters, digits, underscores and single blanks only, but for phrases in ``keep`` (lower case)."""
    bare = squeeze(F.regexp_replace(_col(c), r"[^\p{L}\p{N}_\s]", ""))
    return F.when(F.lower(_col(c)).isin(*keep), squeeze(_col(c))).otherwise(bare) if keep else bare


def ipc_prefix(c: Column | str, n: int = 3) -> Column:
    return F.substring(F.trim(_col(c)), 1, n)


def descriptions(c: Column | str, level: Column | int) -> Column:
    """Texts in braces for level 1, in parentheses for others, cut at ``; ``."""
    level = F.lit(level) if isinstance(level, int) else level
    inner = F.when(level == 1, F.regexp_extract_all(_col(c), F.lit(r"\{([^}]*)\}"), F.lit(1))).otherwise(F.regexp_extract_all(_col(c), F.lit(r"\(([^)]*)\)"), F.lit(1)))
    return F.flatten(F.transform(inner, lambda x: F.split(x, "; ", -1)))


def sentences(c: Column | str) -> Column:
    """Pieces between runs of ``.!?``, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_col(c), "[.!?]+", -1), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def escape_query(c: Column | str) -> Column:
    """AND and OR in lower case, characters with a meaning in queries behind a backslash."""
    text = F.regexp_replace(F.regexp_replace(_col(c), r"\bAND\b", "and"), r"\bOR\b", "or")
    return F.regexp_replace(text, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def capitalize(c: Column | str) -> Column:
    """The first character upper, the rest lower case."""
    return F.concat(F.upper(F.substring(_col(c), 1, 1)), F.lower(F.substring(_col(c), F.lit(2), F.length(_col(c)))))


@F.pandas_udf(StringType())
def title_case(texts: pd.Series) -> pd.Series:
    """Upper case after everything that isn't a letter, so after digits too."""
    return texts.map(lambda t: None if t is None else t.title())


def anchors(c: Column | str, prefix: str = "/wiki/") -> Column:
    """Targets of links that begin with a prefix, without it, underscores as blanks."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(f'href="{prefix}([^"]*)"'), F.lit(1)), lambda x: F.replace(x, F.lit("_"), F.lit(" ")))


def page_id(c: Column | str) -> Column:
    """The number after ``curid=``; null if there is none."""
    return F.expr("null") if c is None else F.regexp_extract(_col(c), r"curid=([0-9]+)", 1).try_cast("long")


def page_url(c: Column | str) -> Column:
    return F.concat(F.lit("https://en.wikipedia.org/wiki?curid="), _col(c).cast("string"))


def context(tokens: Column, start: Column, end: Column, most: int) -> tuple[Column, Column]:
    """Tokens left and right of a mention (end exclusive) within a budget of ``most`` tokens for all; what one side leaves unused the other takes."""
    room = F.greatest(F.lit(most) - (end - start), F.lit(0))
    left_has, right_has = start, F.size(tokens) - end
    left_quota = F.floor(room / 2).cast("int")
    right_quota = (room - left_quota).cast("int")
    left = F.least(left_has, F.greatest(left_quota, room - right_has)).cast("int")
    right = F.least(right_has, F.greatest(right_quota, room - left_has)).cast("int")
    return F.slice(tokens, start - left + 1, left), F.slice(tokens, end + 1, right)


def keep_phrase(c: Column | str) -> Column:
    """Whether a phrase of blank-separated tokens may stay: special phrases do; others need two tokens, a fit first word and no stop word."""
    phrase = F.lower(_col(c))
    tokens = F.split(phrase, " ", -1)
    fit = ~F.get(tokens, F.lit(0)).isin(*BAD_FIRST_WORDS) & ~F.arrays_overlap(tokens, F.array(*map(F.lit, BAD_WORDS))) & (F.size(tokens) >= 2)
    return phrase.isin(*SPECIAL_PHRASES) | fit


def simple_phrase_tokens(c: Column | str, most: int = 2) -> Column:
    """The first tokens that are letters and digits only."""
    return F.slice(F.filter(F.split(squeeze(c), " "), lambda w: w.rlike(r"^[\p{L}\p{N}]+$")), 1, most)
