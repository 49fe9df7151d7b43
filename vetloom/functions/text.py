"""Text signals as Column builders: normalising, phrase hits, negation, references, metadata."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetloom.functions.lexicons import BYLINE_LABELS, CITING_NAMES, HONORIFICS, NEGATION_CUES, NEGATION_WINDOW, REFERENCE_NAMES


def normalise(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def hits(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that the text contains, in the order given; plain tests, so they stay in generated code."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases]))


def any_of(text: Column, phrases: Sequence[str]) -> Column:
    test = F.lit(False)
    for p in phrases:
        test = test | F.contains(text, F.lit(p))
    return test


def all_of(text: Column, phrases: Sequence[str]) -> Column:
    test = F.lit(True)
    for p in phrases:
        test = test & F.contains(text, F.lit(p))
    return test


def count_of(text: Column, phrases: Sequence[str]) -> Column:
    return F.size(hits(text, phrases))


def unnegated(text: Column, phrase: str, cues: Sequence[str] = NEGATION_CUES, window: int = NEGATION_WINDOW) -> Column:
    """Whether some occurrence of the phrase has no cue in the window of characters before it."""
    # the phrase is looked for first, as looking back is dear
    behind = f"(?={re.escape(phrase)})" + "".join(rf"(?<!{re.escape(c)}[\s\S]{{0,{window - len(c)}}})" for c in cues)
    return F.contains(text, F.lit(phrase)) & F.rlike(text, F.lit(behind))


def unnegated_hits(text: Column, phrases: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(unnegated(text, p), F.lit(p)) for p in phrases]))


def maximal(found: Column) -> Column:
    """The hits that are no part of another hit."""
    return F.filter(found, lambda x: ~F.exists(found, lambda y: (y != x) & F.contains(y, x)))


def lines(text: Column) -> Column:
    """The lines of a text that aren't blank, trimmed."""
    trimmed = F.transform(F.split(text, r"\R|[\x1c-\x1e]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def last(items: Column, n: int) -> Column:
    size = F.size(items)
    return F.slice(items, F.greatest(size - n + 1, F.lit(1)), F.lit(n))


def worded(text: Column, phrases: Sequence[str]) -> Column:
    """Whether the text has one of the phrases as whole words."""
    return F.rlike(text, F.lit(rf"\b(?:{'|'.join(map(re.escape, phrases))})\b"))


def has_reference_section(text: Column, norm: Column | None = None, split: Column | None = None) -> Column:
    """Names of a reference list as whole words anywhere, or looser ones in the last 80 lines.

    norm and split are the normalised text and its lines, where they are at hand.
    """
    anywhere = worded(normalise(text) if norm is None else norm, REFERENCE_NAMES)
    tail = F.lower(F.array_join(last(lines(text) if split is None else split, 80), " "))
    # there, what begins with "reference" will do, and names of two words may be parts of longer ones
    begins = F.rlike(tail, F.lit(rf"\b{REFERENCE_NAMES[1]}"))
    found = begins | worded(tail, ["bibliography"]) | any_of(tail, [n for n in REFERENCE_NAMES if n.endswith(" cited")])
    return F.coalesce(anywhere | found, F.lit(False))


def cites_references(text: Column) -> Column:
    """The narrower test that red flags use."""
    return worded(text, CITING_NAMES)


def inferred_title(text: Column, skip_markers: bool = True, split: Column | None = None) -> Column:
    """The first of the first 25 lines longer than 15 characters that isn't a page's heading; '' without one.

    skip_markers also passes over page markers, which would otherwise be taken for titles.
    """
    own = F.slice(lines(text) if split is None else split, 1, 25)
    fits = F.filter(own, lambda x: (F.length(x) > 15) & ~F.lower(x).startswith("page ") & (~x.startswith("===== Page ") if skip_markers else F.lit(True)))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(""))


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, r"(19\d{2}|20\d{2}|21\d{2})", 1)


def author_candidates(text: Column, names: Sequence[str] = (), most: int | None = None, split: Column | None = None) -> Column:
    """Distinct author names in order, from the first 200 lines that name an author or one of the known names.

    A line that has the first two known names is a byline, and what it says is taken whole, without a label, marks
    before the first letter or a star at the end. Of other lines, the first name after an honorific is taken.
    """
    label = "|".join(BYLINE_LABELS)
    byline = rf"^[^A-Za-z]*(?:(?i:{label})\s*[:-]?\s*)?(.*?)\s*\*?\s*$"
    person = rf"(?i)\b(?:{'|'.join(HONORIFICS)})\.?(?:\s+[A-Z][A-Za-z.'-]+){{2,}}\b"

    def of_line(x: Column) -> Column:
        own = F.split(F.lower(x), r"\W+")
        wanted = F.arrays_overlap(own, F.array(*[F.lit(n.lower()) for n in [*names, "author"]]))
        name = F.regexp_extract(x, person, 0)
        if len(names) > 1:
            both = F.array_contains(own, names[0].lower()) & F.array_contains(own, names[1].lower())
            name = F.when(both, F.regexp_replace(F.regexp_extract(x, byline, 1), r"(?U)\s+", " ")).otherwise(name)
        return F.when(wanted, F.trim(name)).otherwise("")

    found = F.transform(F.slice(lines(text) if split is None else split, 1, 200), of_line)
    unique = F.array_distinct(F.filter(found, lambda x: x != ""))
    return F.slice(unique, 1, most) if most else unique


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor blank, else ''."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


def half_even(x: Column, places: int = 0) -> Column:
    """Rounding with ties to even, as scores are rounded."""
    return F.bround(x, places)


def percent(score: Column, most: Column) -> Column:
    return F.coalesce(half_even(F.try_divide(score * 100.0, most.cast("double")), 1), F.lit(0.0))


def safe_name(path: Column) -> Column:
    return F.left(F.regexp_replace(path, r"(?U)[^\w\-]", "_"), F.lit(50))
