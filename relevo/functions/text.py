"""Text scalar functions as Spark Column expressions (JVM side, whole-stage codegen).

Every function takes and returns a ``Column``; nothing here runs Python per row.
Two cleaning pipelines exist, as in the source system:

* app cleaning (``clean_text`` / ``clean_search`` / ``strip_stopwords``): Unicode word
  split, letter-run padding, unit words, stop words;
* notebook cleaning (``remove_special_char`` / ``standardize_measures``): ASCII only,
  digits glued to measurement units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relevo.functions.stopwords import ENGLISH_STOP_WORDS

# --- fixed values: unit word rules of the app cleaning, applied in this order --
UNIT_RULES = [
    ("( gal | gals | galon )", " gallon "),
    ("( ft | fts | feets | foot | foots )", " feet "),
    ("( squares | sq )", " square "),
    ("( lb | lbs | pounds )", " pound "),
    ("( oz | ozs | ounces | ounc )", " ounce "),
    ("( yds | yd | yards )", " yard "),
]

# --- fixed values: measurement rules of the notebook cleaning, in this order ----
# (kind, pattern, replacement); kind "re" is a regex with $n groups, "lit" a plain
# string replacement.
MEASURE_RULES = [
    ("re", r"([0-9])( *)\.( *)([0-9])", "$1.$4"),
    ("re", r"([0-9]+)( *)(inches|inch|in|')\.?", "$1 in. "),
    ("re", r"([0-9]+)( *)(foot|feet|ft|'')\.?", "$1 ft. "),
    ("re", r"([0-9]+)( *)(pounds|pound|lbs|lb)\.?", "$1 lb. "),
    ("re", r"([0-9]+)( *)(square|sq) ?\.?(feet|foot|ft)\.?", "$1 sq.ft. "),
    ("re", r"([0-9]+)( *)(cubic|cu) ?\.?(feet|foot|ft)\.?", "$1 cu.ft. "),
    ("re", r"([0-9]+)( *)(gallons|gallon|gal)\.?", "$1 gal. "),
    ("re", r"([0-9]+)( *)(ounces|ounce|oz)\.?", "$1 oz. "),
    ("re", r"([0-9]+)( *)(centimeters|cm)\.?", "$1 cm. "),
    ("re", r"([0-9]+)( *)(milimeters|mm)\.?", "$1 mm. "),
    ("lit", "°", " degrees "),
    ("re", r"([0-9]+)( *)(degrees|degree)\.?", "$1 deg. "),
    ("lit", " v ", " volts "),
    ("re", r"([0-9]+)( *)(volts|volt)\.?", "$1 volt. "),
    ("re", r"([0-9]+)( *)(watts|watt)\.?", "$1 watt. "),
    ("re", r"([0-9]+)( *)(amperes|ampere|amps|amp)\.?", "$1 amp. "),
    ("re", " +", " "),
]

# Glued-word pattern: an optional capital followed by non-capitals, or a run of capitals.
GLUED_WORD_PATTERN = r"[A-Z]?[^A-Z\s]+|[A-Z]+"
# -------------------------------------------------------------------------------

# Unicode "non word" run. Java's UNICODE_CHARACTER_CLASS gives the Unicode \w
# (letters, marks, decimal digits, connector punctuation, join controls).
# ASCII letters and digits are named first, since that test is far cheaper than the Unicode one.
NON_WORD = r"(?U)[^a-zA-Z0-9\w]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def standardize_units(c) -> Column:
    """Pad with blanks and apply the six unit word rules in order."""
    s = F.concat(F.lit(" "), _c(c), F.lit(" "))
    for pat, rep in UNIT_RULES:
        words = "|".join(w.strip() for w in pat.strip("()").split("|"))  # the same rule with its blanks outside: most places fail at the first of them
        s = F.regexp_replace(s, f" (?:{words}) ", rep)
    return s


def _app_clean(c, search: bool) -> Column:
    s = F.replace(_c(c), F.lit("in."), F.lit(" inch "))
    s = F.lower(F.regexp_replace(s, NON_WORD, " "))
    s = F.regexp_replace(s, "([A-Za-z]+)", " $1 ")
    s = standardize_units(s)
    if search:
        s = F.replace(s, F.lit(" in "), F.lit(" inch "))
    return F.trim(F.regexp_replace(s, " +", " "))


def clean_text(c) -> Column:
    """App cleaning of product text."""
    return _app_clean(c, search=False)


def clean_search(c) -> Column:
    """App cleaning of a search phrase (adds ``in`` -> ``inch``)."""
    return _app_clean(c, search=True)


def strip_stopwords(c, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """T4: isolate ``_``, split on blanks, drop stop words, join with one blank."""
    toks = split_ws(F.replace(_c(c), F.lit("_"), F.lit(" _ ")))
    # `isin` over many literals becomes a hash set lookup (InSet), not a scan of the list per token
    return F.array_join(F.filter(toks, lambda t: ~t.isin(*stop_words)), " ")


def remove_bullets(c) -> Column:
    """T5: drop ``bullet NN `` markers."""
    return F.regexp_replace(_c(c), r"bullet \d\d ", "")


def split_glued_words(c) -> Column:
    """``anglesMake`` -> ``angles Make``; blanks are dropped, tokens joined by one blank."""
    return F.array_join(F.regexp_extract_all(_c(c), F.lit(GLUED_WORD_PATTERN), 0), " ")


def first_n_words(c, n: int, missing: str = "error101") -> Column:
    """The first n blank-separated words, or ``missing`` when there are fewer."""
    toks = split_ws(c)
    return F.when(F.size(toks) < n, F.lit(missing)).otherwise(F.array_join(F.slice(toks, 1, n), " "))


def remove_special_char(c) -> Column:
    """Runs of anything but ASCII letters and digits become one blank; lower case."""
    return F.lower(F.regexp_replace(_c(c), "[^A-Za-z0-9]+", " "))


def standardize_measures(c) -> Column:
    """Digits followed by a unit become ``N unit.``; rules applied in order."""
    s = _c(c)
    for kind, pat, rep in MEASURE_RULES:
        s = F.regexp_replace(s, pat, rep) if kind == "re" else F.replace(s, F.lit(pat), F.lit(rep))
    return s


def split_ws(c) -> Column:
    """Whitespace split dropping empty tokens (``str.split()``); '' -> []."""
    t = F.trim(F.regexp_replace(_c(c), r"\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def split_blank(c) -> Column:
    """Split on single blanks keeping empty tokens (``str.split(' ')``)."""
    return F.split(_c(c), " ")


def word_tokens(c) -> Column:
    """Lower-cased Unicode ``\\w+`` runs."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(?U)\w+"), 0)


def word_tokens_min2(c) -> Column:
    """Lower-cased word tokens of at least two characters (TF-IDF vocabulary)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(?U)\b\w\w+\b"), 0)


def ngrams(tokens, n: int) -> Column:
    """Word n-grams (joined by a blank) of a token array; [] when shorter than n."""
    t = _c(tokens)
    return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                    lambda i: F.array_join(F.slice(t, i, n), " ")))


def bigrams(tokens) -> Column:
    """Adjacent token pairs joined by a blank (a blank never occurs inside a token), as
    strings so ``array_distinct`` can hash them; one cheap lambda per pair."""
    t = _c(tokens)
    m = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, m), F.slice(t, 2, m), lambda a, b: F.concat(a, F.lit(" "), b))


def digit_tokens(c) -> Column:
    """Tokens of ``str.split(' ')`` made only of ASCII digits (a regex, not a per-token lambda)."""
    return F.regexp_extract_all(_c(c), F.lit(r"(?<![^ ])[0-9]+(?![^ ])"), 0)


def substring_count(doc, word) -> Column:
    """Non-overlapping occurrences of ``word`` inside ``doc`` (counts inside words)."""
    d, w = _c(doc), _c(word)
    return F.when(F.length(w) == 0, F.length(d) + 1).otherwise(
        F.floor((F.length(d) - F.length(F.replace(d, w, F.lit("")))) / F.length(w)).cast("int"))


def is_digit_token(c) -> Column:
    """``str.isdigit`` for ASCII text."""
    return _c(c).rlike("^[0-9]+$")


def char_set(c) -> Column:
    """Character set of a word as a sorted distinct array ('' -> [])."""
    w = _c(c)
    return F.when(F.length(w) == 0, F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.split(w, ""))))
