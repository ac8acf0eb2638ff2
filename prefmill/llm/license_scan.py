"""License scans: fuzzy short-notice search (op 3).

Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased; all bytes of a non-ASCII character belong to
words, so the scan works on UTF-8 bytes, words joined by one space. Base phrases are counted where their words stand
consecutively. A notice of the table below may have up to `k` edits (characters inserted, deleted or changed): it is
cut into k+1 pieces, one of which must stand unchanged (pigeonhole), an Aho-Corasick automaton finds the pieces, and
the regex library's bounded-error matching looks for the best match in a window of one notice's length around each
piece. Of matches that overlap the best stays (of equal ones the first); what is left of a window on either side of it
is searched again, so poorer matches beside it are found too. Windows are no longer than a notice and its edits, so
time is in proportion to the text.

Cases: null is the empty text: n_words 0, no labels, score 0. Rows of equal doc_id stay separate.
score: 1 for an exact match, 1 - edits / length for the best fuzzy one, 0 for none.
"""

from __future__ import annotations

import bisect
import heapq
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: Phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: The method's notices: text, label, permitted edits.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("licensed under the apache license version 2 0", "apache-2.0", 3),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 5),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("general public license", "gpl", 2),
    ("all rights reserved", "reserved", 2),
    ("creative commons attribution", "cc-by", 2),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("mozilla public license version 2 0", "mpl-2.0", 3),
    ("this work is in the public domain", "public-domain", 2),
)


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """k+1 pieces of nearly equal length with their offsets."""
    cut = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cut, cut[1:])]


class NoticeScanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        import ahocorasick
        import regex

        self.phrases = [(p.encode(), label, len(p.split())) for p, label in phrases]
        self.notices = [(text, label, k, regex.compile(rf"(?b)(?:{regex.escape(text)}){{e<={k}}}")) for text, label, k in notices]
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list] = {}
        for i, (text, _, k, _) in enumerate(self.notices):
            for offset, piece in pieces(text, k):
                at.setdefault(piece, []).append((i, offset, len(piece)))
        for piece, where in at.items():
            self.seeds.add_word(piece, where)
        self.seeds.make_automaton()

    def exact(self, joined: bytes):
        """(label, first byte) of each place of a base phrase; joined has a space at either end."""
        for phrase, label, n in self.phrases:
            needle, at = b" " + phrase + b" ", -1
            while (at := joined.find(needle, at + 1)) >= 0:
                yield label, at + 1, n

    def fuzzy(self, joined: str):
        """(label, start, end, edits, length of the notice), spans in characters of the joined words."""
        windows: dict[int, set] = {}
        for end, where in self.seeds.iter(joined):
            for i, offset, size in where:
                text, _, k, _ = self.notices[i]
                begin = end + 1 - size - offset
                windows.setdefault(i, set()).add((max(0, begin - k), min(begin + len(text) + k, len(joined))))
        for i, spans in windows.items():
            text, label, k, pattern = self.notices[i]
            for m in self.apart(pattern, joined, sorted(spans), len(text) - k):
                yield label, m.start(), m.end(), sum(m.fuzzy_counts), len(text)

    @classmethod
    def matches(cls, pattern, joined: str, low: int, high: int):
        """The best match between two places, and those before and after it in the same way, by place."""
        return cls.apart(pattern, joined, [(low, high)], 1)

    @staticmethod
    def apart(pattern, joined: str, windows: list, least: int):
        """Matches of at least so many characters in windows, by place: of those that overlap, the best."""
        best, starts, ends, found, ticket = [], [], [], [], itertools.count()

        def search(low: int, high: int):
            if high - low >= least and (m := pattern.search(joined, low, high)):
                heapq.heappush(best, (sum(m.fuzzy_counts), m.start(), m.end(), low, high, next(ticket), m))

        def taken(low: int, high: int) -> slice:
            """Which of the matches that have been taken reach into this stretch; they are sorted and apart."""
            return slice(bisect.bisect_right(ends, low), bisect.bisect_left(starts, high))

        for low, high in windows:
            search(low, high)
        while best:
            _, start, end, low, high, _, m = heapq.heappop(best)
            if not starts[taken(start, end)]:
                at = bisect.bisect_left(starts, start)
                starts.insert(at, start)
                ends.insert(at, end)
                found.insert(at, m)
            near = taken(low, high)
            for left, right in zip([low, *ends[near]], [*starts[near], high]):
                search(left, right)
        return found

    def scan(self, text: bytes) -> dict:
        words = text.translate(common.WORD_BYTES).split()
        joined = b" " + b" ".join(words) + b" "
        base = list(self.exact(joined))
        first, last = (min(a for _, a, _ in base), max(a for _, a, _ in base)) if base else (None, None)
        fuzzy = list(self.fuzzy(joined.decode())) if words else []
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": None if first is None else joined.count(b" ", 0, first) - 1,
            "last_word": None if last is None else joined.count(b" ", 0, last) - 1,
            "base_labels": ",".join(sorted({x[0] for x in base})),
            "labels": ",".join(sorted({x[0] for x in base} | {x[0] for x in fuzzy})),
            "score": max([1.0] * bool(base) + [1 - e / n for _, _, _, e, n in fuzzy], default=0.0),
            "spans": [{"label": x[0], "start": x[1] - 1, "end": x[2] - 1, "edits": x[3]} for x in fuzzy],
        }


_SQL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, edits: long>>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])))])


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """A row for each document; spans: matches of the notices, in characters of the words joined by one space."""

    def run(batches):
        scanner = NoticeScanner(phrases, notices)
        for b in batches:
            rows = [scanner.scan(t) | {"doc_id": i} for i, t in zip(b.column("doc_id").to_pylist(), common.raw_bytes(b.column("text")))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SQL)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.documents(spark, sf_dir)).drop("spans")


