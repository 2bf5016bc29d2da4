"""Text cleanup as column expressions: links, markup, personal data, keys, quotes."""

from __future__ import annotations

import re

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.nested import bound


def link_key(url: Column) -> Column:
    """One key for a link: no scheme, no ``m.``, no query or fragment, no trailing slash, lower case."""
    out = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    for pattern in (r"^https?://", r"^m\.", r"[#?].*$", r"/+$"):
        out = F.regexp_replace(out, pattern, "")
    return out


def strip_markup(html: Column) -> Column:
    """Plain text of markup: scripts, styles and comments go, tags become blanks, common entities are decoded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


@dataclass(frozen=True)
class Numbers:
    """A kind of telephone number: how it begins, how many digits its other groups have, and whether blanks, dots or hyphens must part them."""

    begins: tuple[str, ...]
    groups: tuple[tuple[int, int], ...]
    parted: bool = False

    def pattern(self) -> str:
        mark = "[-. ]" if self.parted else "[-. ]?"
        return f"(?:{'|'.join(self.begins)})" + "".join(f"{mark}[0-9]{{{low},{high}}}" for low, high in self.groups)


#: The numbering plan: mobile, forwarding and area numbers, and any other number written in three parts.
PLAN = (
    Numbers(("01[0-9]",), ((3, 4), (4, 4))),
    Numbers(("050[0-9]",), ((3, 4), (3, 4))),
    Numbers(("02", "0[3-6][0-9]"), ((3, 4), (4, 4))),
    Numbers(("[0-9]{2,4}",), ((3, 4), (4, 4)), parted=True),
)


def number_pattern(plan: tuple[Numbers, ...] = PLAN) -> str:
    """One pattern for all kinds of a plan; it takes whole runs of digits only."""
    return r"\b(?:" + "|".join(kind.pattern() for kind in plan) + r")\b"


def without_contacts(text: Column, plan: tuple[Numbers, ...] = PLAN, mark: str = "[tel]") -> Column:
    """The words of a text, single-spaced, without mail addresses and handles, every telephone number replaced by ``mark``."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+"), lambda w: (w != "") & ~F.rlike(w, F.lit("@.")))
    return F.regexp_replace(F.array_join(words, " "), number_pattern(plan), mark)


def text_key(text: Column, chars: int = 60) -> Column:
    """Lower case without blanks, cut: the key by which copies of a text are recognised. Its length is a fixed value: other keys would tell other copies apart."""
    return F.substring(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\r\n]+", ""), 1, chars)


def normal_name(name: Column) -> Column:
    """Letters and digits of a name in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}]", ""))


def sentences(text: Column, shortest: int = 5) -> Column:
    """The sentences of a text, in order: lines, cut after closing marks that a blank follows; shorter ones are left out."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?…])[ \t\r]+", "$1\n"), "\n")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: F.char_length(x) >= shortest)


def best_sentence(text: Column, weights: dict[str, int], most: int = 90, plan: tuple[Numbers, ...] = PLAN) -> Column:
    """The sentence with the highest sum of ``weights`` over the patterns that it holds in lower case, the earlier one at ties.

    Sentences that their source cut off (they end in dots) give way to whole ones. Contacts are taken out, and what is
    longer than ``most`` ends in an ellipsis. A text without a sentence is its own.
    """
    cut_off = lambda s: F.rlike(s, F.lit(r"(?:\.{3}|…)$"))

    def rank(s: Column, i: Column) -> Column:
        points = sum((F.when(F.rlike(F.lower(s), F.lit(p)), n).otherwise(0) for p, n in weights.items()), F.lit(0))
        return F.struct((~cut_off(s)).alias("whole"), points.alias("points"), (-i).alias("early"), s.alias("sentence"))

    best = F.array_max(F.transform(sentences(text), rank))["sentence"]
    shown = without_contacts(F.coalesce(best, text), plan)
    return F.when(F.char_length(shown) <= most, shown).otherwise(F.concat(F.left(shown, F.lit(most)), F.lit("…")))


def keyword_count(text: Column, words: tuple[str, ...]) -> Column:
    """Occurrences of each word in a text, summed; occurrences of one word do not overlap."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for w in words:
        total = total + ((F.char_length(low) - F.char_length(F.replace(low, F.lit(w.lower()), F.lit("")))) / len(w)).cast("int")
    return total


def affirmed(text: Column, words: tuple[str, ...], denial: str, before: int = 14, after: int = 10) -> Column:
    """Whether a text mentions a word at least once without a denial in the window around it.

    Windows are only cut where a text holds both a word and a denial. The look-behind takes ``before`` characters, or all
    of them near the start.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    alternatives = "|".join(w.lower() for w in words)
    place = F.lit(rf"(?s)(?=((?:{alternatives}).{{0,{after}}}))(?<=(^.{{0,{before - 1}}}|.{{{before}}}))")
    windows = F.zip_with(F.regexp_extract_all(low, place, F.lit(2)), F.regexp_extract_all(low, place, F.lit(1)), lambda a, b: F.concat(a, b))
    free = F.exists(windows, lambda w: ~F.rlike(w, F.lit(denial)))
    return F.when(~F.rlike(low, F.lit(alternatives)), False).when(~F.rlike(low, F.lit(denial)), True).otherwise(free)


def said_and_denied(text: Column, words: tuple[str, ...], denial: str, reach: int = 14) -> Column:
    """(said, denied): whether some occurrence of a word has no denial, and whether some has one, in the ``reach`` characters
    before and behind it. Every occurrence counts, overlapping ones too."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def cut(low: Column, w: str) -> Column:
        own = re.escape(w.lower())
        around = rf"(?=(.{{0,{reach}}}))", rf"(^.{{0,{reach - 1}}}|.{{{reach}}})"
        # a pattern that begins with the word is found faster, but passes over an occurrence that begins in the one before
        overlaps = any(w.lower().startswith(w.lower()[k:]) for k in range(1, len(w)))
        place = F.lit(rf"(?s)(?={own}(.{{0,{reach}}}))(?<={around[1]})" if overlaps else rf"(?s){own}{around[0]}(?<={around[1]}{own})")
        both = F.zip_with(F.regexp_extract_all(low, place, F.lit(2)), F.regexp_extract_all(low, place, F.lit(1)), lambda a, b: F.concat(a, F.lit(w.lower()), b))
        return F.when(F.contains(low, F.lit(w.lower())), both).otherwise(F.array().cast("array<string>"))  # cut only where a text holds the word at all

    # windows are cut once, and each is told once
    denials = lambda low: F.transform(F.flatten(F.array(*[cut(low, w) for w in words])), lambda x: F.rlike(x, F.lit(denial)))
    return bound(bound(low, denials), lambda d: F.struct(F.exists(d, lambda x: ~x).alias("said"), F.exists(d, lambda x: x).alias("denied")))


def particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """A Korean particle by the final consonant of a word; words that do not end in a syllable take the vowel form."""
    code = F.ascii(F.right(word, F.lit(1)))  # fixed values: Hangul syllables lie at AC00-D7A3 in groups of 28 finals
    return F.when(code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 != 0), after_consonant).otherwise(after_vowel)
