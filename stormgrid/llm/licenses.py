"""License scans: fuzzy search for short notices by exact seeds and bounded-error matching."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.llm.common import sliced, small_batches, table

# Base phrases that count only where they stand exactly.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Notices of the fuzzy search, with their label and the most edits (characters) they may have.
NOTICES = [
    ("gnu general public license", "gpl", 2),
    ("apache license", "apache", 1),
    ("cc by", "cc-by", 0),
    ("mit license", "mit", 1),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 2),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 7),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
    ("this program is free software you can redistribute it and or modify it", "gpl", 6),
    ("spdx license identifier", "spdx", 2),
    ("all rights reserved", "reserved", 1),
]

# Bytes that are no part of a word become blanks; A-Z become a-z.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_HITS = "n_words bigint, hits array<struct<notice: string, label: string, word: bigint, n_words: bigint, edits: int, span: string>>"
_HIT_TYPE = pa.list_(
    pa.struct(
        [
            ("notice", pa.string()),
            ("label", pa.string()),
            ("word", pa.int64()),
            ("n_words", pa.int64()),
            ("edits", pa.int32()),
            ("span", pa.string()),
        ]
    )
)


class Finder:
    """Seeds, and for each notice a pattern that allows its edits."""

    def __init__(self, notices: list[tuple[str, str, int]]) -> None:
        self.notices = notices
        self.patterns = [
            regex.compile(rf"(?<= )(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}(?= )", regex.BESTMATCH)
            for text, _, k in notices
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (text, _, k) in enumerate(notices):
            # k edits touch at most k of k + 1 pieces, so one piece stands in every match exactly.
            cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                seeds.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def search(self, text: str | None) -> tuple[int, list[tuple[str, str, int, int, int, str]]]:
        """The number of words, and (notice, label, first word, words, edits, span) of each hit."""
        words = (text or "").encode().translate(_WORD_BYTES).split()
        if not words:
            return 0, []
        line = " " + b" ".join(words).decode() + " "
        places: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(line):
            for n, offset in uses:
                places.setdefault(n, []).append(end + 1 - size - offset)
        hits: dict[tuple[int, int], tuple[int, int]] = {}
        for n, starts in places.items():
            notice, _, most = self.notices[n]
            for at in set(starts):
                if at > 0 and line.startswith(f" {notice} ", at - 1):
                    hits[n, at] = at + len(notice), 0
            for at in sorted(set(starts)) if most else ():
                # A match that this seed belongs to lies in its surroundings, whatever stands beside it.
                self.near(line, n, max(0, at - most - 1), min(at + len(notice) + most + 1, len(line)), hits)
        blanks = [i for i, c in enumerate(line) if c == " "] if hits else []
        out = [
            (*self.notices[n][:2], bisect_left(blanks, a) - 1, bisect_left(blanks, b) - bisect_left(blanks, a) + 1, edits, line[a:b])
            for (n, a), (b, edits) in sorted(hits.items(), key=lambda x: (x[0][1], x[0][0]))
        ]
        return len(words), out

    def near(self, line: str, n: int, a: int, b: int, hits: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Add the best match between a and b, and those before and behind it."""
        notice, _, most = self.notices[n]
        regions = [(a, b)]
        while regions:
            a, b = regions.pop()
            m = self.patterns[n].search(line, a, b)
            if m is None:
                continue
            known = hits.get((n, m.start()))
            if known is None or known[1] > sum(m.fuzzy_counts):
                hits[n, m.start()] = m.end(), sum(m.fuzzy_counts)
            regions += [x for x in ((a, m.start()), (m.end(), b)) if x[1] - x[0] >= len(notice) - most]


_finders: dict[tuple, Finder] = {}


def scan(df: DataFrame, notices: list[tuple[str, str, int]] = NOTICES, text_col: str = "text") -> DataFrame:
    """Add n_words and hits: the places where a notice stands with at most its number of edits.

    Texts are lower-cased (A-Z) and reduced to words. A notice with k edits is cut into k + 1
    pieces; an Aho-Corasick automaton finds the pieces, and only the surroundings of a piece are
    matched with bounded errors. Matches begin and end at words. Exact places are all reported,
    also where they overlap a fuzzy one; a fuzzy match takes the fewest edits at its start.

    Null, empty and wordless texts have 0 words and no hits; columns named n_words or hits are
    replaced, others stay.
    """
    key = tuple(notices)
    made = ["n_words", "hits"]
    keep = [c for c in df.columns if c.lower() not in made]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), _HITS])
    names = ("notice", "label", "word", "n_words", "edits", "span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _finders:
            _finders[key] = Finder(list(key))
        finder = _finders[key]
        for batch in batches:
            found = [finder.search(t) for t in batch.column(text_col).to_pylist()]
            columns = [batch.column(c) for c in keep]
            columns.append(pa.array([n for n, _ in found], pa.int64()))
            columns.append(pa.array([[dict(zip(names, h, strict=True)) for h in x] for _, x in found], _HIT_TYPE))
            yield from sliced(pa.RecordBatch.from_arrays(columns, [*keep, *made]))

    return df.mapInArrow(run, schema)


def summary(scanned: DataFrame) -> DataFrame:
    """Base places and labels of each document, with a score: the nearest hit's share of unedited characters."""
    exact = " or ".join(f"(h.notice = '{text}' and h.edits = 0)" for text, _ in BASE)
    return (
        scanned.withColumn("base", F.expr(f"filter(hits, h -> {exact})"))
        .withColumn("nearest", F.expr("array_max(transform(hits, h -> 1D - h.edits / cast(length(h.notice) as double)))"))
        .select(
            "doc_id",
            "n_words",
            F.size("base").cast("long").alias("n_base"),
            F.array_min("base.word").alias("first_word"),
            F.array_max("base.word").alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct("hits.label")), ",").alias("labels"),
            F.coalesce("nearest", F.lit(0.0)).alias("score"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return summary(scan(docs).select("doc_id", "n_words", "hits"))
