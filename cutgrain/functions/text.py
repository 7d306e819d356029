"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about what is shown (fixed values).
FUNCTION_WORDS = (
    "about above across after against along also among around before behind being below beneath beside between both during each from have into just near onto other over "
    "some that their them then there these they this through toward towards under very where which while with"
).split()
FOOTAGE_WORDS = (
    "aerial angle background camera captured clip close closer closeup filmed footage foreground frame framed framing lapse overhead panning scene seen shot show shown "
    "showing time timelapse video view viewed visible wide wider zoom zoomed zooming"
).split()
STOP_WORDS = FUNCTION_WORDS + FOOTAGE_WORDS
LEAST_LETTERS = 4
STEM_LETTERS = 4
#: Stretches with fewer distinct words aren't compared by words.
LEAST_WORDS = 3


def trim(x: Column) -> Column:
    """Without Unicode white space at both ends (Spark's own trim knows only U+0020)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return trim(F.regexp_replace(x, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Stems of the words that say what a text shows, in order, repeats kept; null for null."""
    found = F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+")
    stops = [w + s for w in STOP_WORDS for s in ("", "s")]  # looked up by hash
    return F.transform(F.filter(found, lambda w: (F.char_length(w) >= LEAST_LETTERS) & ~w.isin(stops)), lambda w: F.substring(w, 1, STEM_LETTERS))


def word_set(text: Column) -> Column:
    """Distinct stems, or none where there are too few to compare."""
    own = F.array_distinct(words(text))
    return F.when(F.size(own) >= LEAST_WORDS, own).otherwise(F.expr("cast(array() as array<string>)"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def repeats_summary(description: Column, summary: Column) -> Column:
    """Whether a description only says what the summary says."""
    d, s = F.lower(trim(description)), F.lower(trim(summary))
    return (d == s) | ((F.char_length(d) >= 20) & F.contains(s, d))


def format_time(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; negative times are 0."""
    t = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    h, m, s = F.floor(t / 3600).cast("bigint"), F.floor(t % 3600 / 60).cast("bigint"), t % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def parse_at(text: Column) -> Column:
    """[h:]m:s.f or seconds -> seconds; null where it isn't one, or is negative."""
    parts = F.transform(F.split(trim(text), ":"), lambda x: x.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when((F.size(parts) <= 3) & ~F.exists(parts, lambda x: x.isNull() | (x < 0)), total)


def dollars(usd: Column) -> Column:
    """Four decimals, zeros beyond the second dropped."""
    return F.regexp_replace(F.format_string("$%.4f", usd), r"(\.\d\d)(\d*?)0+$", "$1$2")


def parse_cost(text: Column) -> Column:
    """A positive, finite number of dollars, with or without the sign; else null."""
    x = F.regexp_replace(trim(text), r"^\$", "").try_cast("double")
    return F.when((x > 0) & (x < float("inf")), x)
