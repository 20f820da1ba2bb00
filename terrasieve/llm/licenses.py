"""Licence scans: fuzzy search for short notices with exact seeds."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words are runs of what this does not match.
_NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(common.UPPER, common.UPPER.lower())


@dataclass(frozen=True)
class Notice:
    """A phrase in normal form (lower-case words, one space apart), its label,
    and the edits (inserted, lost or changed characters) still accepted."""

    phrase: str
    label: str
    edits: int


#: The base phrases come first and are found with any number of edits up to
#: theirs; n_base counts the exact ones among them.
BASE = (
    Notice("gnu general public license", "gpl", 3),
    Notice("apache license", "apache", 1),
    Notice("cc by", "cc-by", 0),
    Notice("mit license", "mit", 1),
)
NOTICES = BASE + (
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("bsd 3 clause license", "bsd", 2),
    Notice("bsd 2 clause license", "bsd", 2),
    Notice("boost software license", "boost", 2),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
)

MATCHES = "array<struct<phrase:string,label:string,first_word:long,last_word:long,edits:int,similarity:double,exact:boolean,text:string>>"

_FIELDS = ("phrase", "label", "first_word", "last_word", "edits", "similarity", "exact", "text")


def seeds(phrase: str, edits: int) -> list[tuple[int, str]]:
    """The phrase cut into edits + 1 pieces of nearly equal length, each with
    its place: a match with at most so many edits holds one unchanged."""
    parts = edits + 1
    cuts = [len(phrase) * i // parts for i in range(parts + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Finds notices in one text after another; built once in each task."""

    def __init__(self, notices: Sequence[Notice]):
        self.notices = list(notices)
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(self.notices):
            for at, piece in seeds(notice.phrase, notice.edits):
                places.setdefault(piece, []).append((n, at))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()
        # whole words only; the best match first
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}(?![^ ])") for n in self.notices]
        self.verify = lru_cache(maxsize=20_000)(self._verify)

    def _verify(self, n: int, window: str) -> tuple[tuple[int, int, int], ...]:
        """(start, end, edits) of the matches in a window."""
        out = []
        for m in self.patterns[n].finditer(window):
            a, b = m.span()
            while a < b and window[a] == " ":
                a += 1
            while b > a and window[b - 1] == " ":
                b -= 1
            out.append((a, b, sum(m.fuzzy_counts)))
        return tuple(out)

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        """Word count and matches (as in ``MATCHES``), by place and phrase."""
        normal = _NOT_WORD.sub(" ", text.translate(_LOWER)).strip(" ")
        n_words = normal.count(" ") + 1 if normal else 0
        found: dict[tuple[int, int], tuple[int, int]] = {}  # (notice, start) -> (edits, end)
        for end, (length, places) in self.automaton.iter(normal):
            for n, at in places:
                notice = self.notices[n]
                start = end - length + 1 - at
                # from the word where the match can begin to the one where it can end
                low = max(0, start - notice.edits)
                high = min(len(normal), start + len(notice.phrase) + notice.edits)
                # (a word that reaches past ``reach`` more is too long to be part of a match, and is cut there)
                reach = len(notice.phrase) + notice.edits + 2
                word = normal.rfind(" ", max(0, low - reach), low)
                low = word + 1 if word >= 0 else max(0, low - reach)
                if high < len(normal) and normal[high] != " ":
                    word = normal.find(" ", high, high + reach)
                    high = word if word >= 0 else min(len(normal), high + reach)
                exact_at = start if start >= 0 and normal.startswith(notice.phrase, start) else -1
                if exact_at >= 0 and (start == 0 or normal[start - 1] == " ") and normal[start + len(notice.phrase) : start + len(notice.phrase) + 1] in ("", " "):
                    found[n, start] = (0, start + len(notice.phrase))
                    continue
                for a, b, edits in self.verify(n, normal[low:high]) if notice.edits else ():
                    key = (n, low + a)
                    if key not in found or found[key][0] > edits:
                        found[key] = (edits, low + b)
        kept = []
        for (n, a), (edits, b) in sorted(found.items(), key=lambda x: (x[0][0], x[1][0], x[0][1])):
            # of overlapping matches of one phrase the better stays; exact ones all stay
            if edits == 0 or not any(m == n and a < d and c < b for m, c, d, _ in kept):
                kept.append((n, a, b, edits))
        out, done, words = [], 0, 0
        for n, a, b, edits in sorted(kept, key=lambda x: (x[1], x[0])):
            words += normal.count(" ", done, a)
            done = a
            notice = self.notices[n]
            exact = edits == 0 and normal[a:b] == notice.phrase
            out.append((notice.phrase, notice.label, words, words + normal.count(" ", a, b), edits, 1 - edits / len(notice.phrase), exact, normal[a:b]))
        return n_words, out


def scan_notices(df: DataFrame, text: str = "text", notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """Add n_words and matches (an array of ``MATCHES``) to each row.

    The text is normalised to lower-case words one space apart. Each phrase
    is cut into one piece more than its edits, so a match holds a piece
    unchanged (pigeonhole); an Aho-Corasick automaton finds the pieces, and
    the ``regex`` library's bounded-error matching verifies the words around
    them. Words in spans count from 0. Null and blank texts have no words and
    no matches. Other columns stay; those of the two names are replaced.
    """

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(notices)
        for batch in batches:
            found = [scanner.scan(t or "") for t in batch]
            yield pd.DataFrame({"n_words": [n for n, _ in found], "matches": [[dict(zip(_FIELDS, m)) for m in ms] for _, ms in found]})

    scanned = F.pandas_udf(work, f"n_words long, matches {MATCHES}")
    out = df.withColumn("_scan", scanned(F.col(text)))
    return out.withColumns({"n_words": F.col("_scan.n_words"), "matches": F.col("_scan.matches")}).drop("_scan")


def op2_fuzzy_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document, exact ones apart from fuzzy ones.

    The score is the best similarity of a match (1 - edits / length of the
    phrase), 0 without one.
    """
    scanned = scan_notices(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["exact"] & m["phrase"].isin([n.phrase for n in BASE]))
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["first_word"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0)).alias("score"),
        "matches",
    )
