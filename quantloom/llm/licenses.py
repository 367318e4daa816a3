"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is marked-up wording: `[[words]]` may be absent, `{{name:n}}` stands for up to n words of any
kind (`{{name}}`: up to 12); all other words are mandatory and must match exactly, one after another.
Optional regions may hold slots and other regions, and a template may begin with regions. It is found
wherever its automaton accepts a run of consecutive words; of the runs around one place of its anchor (the
first mandatory words outside all regions) the one that starts first and is longest counts.
Beside templates there are phrases: their words, consecutively.

Words: A to Z are lower-cased and `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` taken, so digits, ASCII letters and
everything beyond ASCII.

One narrow mapInArrow pass; a row's cost grows with its own length only. An automaton is run only from
places that its anchor, found by substring search, can be reached from.

Defined results: a null text has no words (counts 0, places null, labels empty, score 0); repeated rows
give repeated results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.common import read_table, texts

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# The wording of notices and of whole licence texts that many projects publish unchanged.
_DISCLAIMER_MIT = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    " in no event shall the {{authors:8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_DISCLAIMER_BSD = (
    "this software is provided by {{holders:12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall {{holders:12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits"
    " or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD = (
    "[[copyright [[c]] {{holder:16}} [[all rights reserved]]]] redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2.0": "licensed under the apache license version 2 0 [[the license]]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mit-notice": "released under [[the]] mit license",
    "isc": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted",
    "gpl-terms": "under the terms of the gnu [[lesser]] [[affero]] general public license",
    "gpl-notice": "licensed under the gnu [[lesser]] [[affero]] general public license [[version]] {{version:1}}",
    "cc-by-notice": "licensed under [[a]] [[the]] creative commons attribution {{terms:3}} license",
    "cc-by-short": "licensed under [[the]] cc by [[sa]] [[nc]] [[nd]] {{version:2}} [[license]]",
    "copyright-reserved": "copyright [[c]] {{holder:12}} all rights reserved",
    "mit-text": (
        "[[the]] [[mit license [[mit]]]] [[copyright [[c]] {{holder:16}} [[all rights reserved]]]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _DISCLAIMER_MIT
    ),
    "isc-text": (
        "[[isc license]] [[copyright [[c]] {{holder:16}}]] permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and {{author:8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{author:8}} be liable for any special direct indirect or consequential damages"
        " or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "bsd-2-text": _BSD + " " + _DISCLAIMER_BSD,
    "bsd-3-text": _BSD + " [[3]] neither the name of {{holder:12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _DISCLAIMER_BSD,
}


def fold_words(text: str | None) -> list[bytes]:
    """The words of a whole text, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


_MARK = re.compile(r"(\[\[)|(\]\])|\{\{(.*?)\}\}")


def parse_markup(markup: str) -> list:
    """Nested lists: words (bytes), slots (numbers) and optional regions (lists)."""
    open_: list[list] = [[]]
    at = 0
    for found in _MARK.finditer(markup):
        open_[-1] += fold_words(markup[at : found.start()])
        at = found.end()
        if found[1]:
            open_.append([])
        elif found[2]:
            if len(open_) == 1:
                raise ValueError(f"a region ends that never began: {markup}")
            region = open_.pop()
            open_[-1].append(region)
        else:
            open_[-1].append(int(found[3].partition(":")[2] or 12))
    if len(open_) > 1:
        raise ValueError(f"a region never ends: {markup}")
    return open_[0] + fold_words(markup[at:])


def _most_words(items: list) -> int:
    return sum(_most_words(x) if isinstance(x, list) else x if isinstance(x, int) else 1 for x in items)


class Automaton:
    """Accepts runs of words. States are numbers; a state has word moves, one 'any word' move and free moves."""

    def __init__(self, markup: str):
        self.moves: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        items = parse_markup(markup)
        self._build(items)
        self.accepting = len(self.moves) - 1
        # the anchor, and the least and most words that may stand before it
        first = next((i for i, x in enumerate(items) if isinstance(x, bytes)), None)
        if first is None:
            raise ValueError("a template needs mandatory words outside its regions")
        last = next((i for i in range(first, len(items)) if not isinstance(items[i], bytes)), len(items))
        self.anchor = b" ".join(items[first:last])
        self.before = _most_words(items[:first])

    def _build(self, items: list) -> None:
        for item in items:
            begin = len(self.moves) - 1
            if isinstance(item, bytes):
                self.moves[begin][item] = self._state()
            elif isinstance(item, int):
                for _ in range(item):
                    last = len(self.moves) - 1
                    self.any[last] = self._state()
                end = self._state()
                for state in range(begin, end):
                    self.free[state].append(end)
            else:
                self._build(item)
                end = self._state()
                self.free[end - 1].append(end)
                self.free[begin].append(end)

    def _state(self) -> int:
        self.moves.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.moves) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for state in self.free[todo.pop()]:
                if state not in states:
                    states.add(state)
                    todo.append(state)
        return states

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted run from start on."""
        states, at, end = self._closed({0}), start, None
        while states:
            if self.accepting in states:
                end = at
            if at == len(words):
                break
            word = words[at]
            nxt = {self.moves[s][word] for s in states if word in self.moves[s]} | {self.any[s] for s in states if self.any[s] is not None}
            states, at = self._closed(nxt), at + 1
        return end


def spans_of(own: Automaton, words: list[bytes], joined: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of what the automaton accepts around each place of its anchor."""
    upto = 0  # starts before it have been tried or are inside an accepted run
    for at in places(joined, own.anchor):
        for start in range(max(upto, at - own.before), at + 1):
            end = own.match(words, start)
            if end is not None and end > at:
                yield start, end
                upto = at + 1
                break


def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which the words of phrase stand in ` w0 w1 ... `."""
    needle, at, word, last = b" " + phrase + b" ", -1, 0, 0
    while (at := joined.find(needle, at + 1)) >= 0:
        word += joined.count(b" ", last, at)
        last = at
        yield word


RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<label:string,start:long,end:long>>"
)
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPAN),
    ]
)


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = [(label, Automaton(markup)) for label, markup in templates.items()]
        self.phrases = [(b" ".join(fold_words(phrase)), label) for phrase, label in phrases.items()]

    def scan(self, doc_id: int | None, text: str | None) -> tuple:
        words = fold_words(text)
        joined = b" " + b" ".join(words) + b" "
        base = [(at, phrase.count(b" ") + 1, label) for phrase, label in self.phrases for at in places(joined, phrase)]
        spans = [{"label": label, "start": at, "end": end} for label, own in self.automata for at, end in spans_of(own, words, joined)]
        base_labels = sorted({label for _, _, label in base})
        labels = sorted({*base_labels, *(s["label"] for s in spans)})
        covered, upto = 0, 0
        for a, b in sorted([(at, at + n) for at, n, _ in base] + [(s["start"], s["end"]) for s in spans]):
            covered += max(0, b - max(a, upto))
            upto = max(upto, b)
        starts = [at for at, _, _ in base]
        return (
            doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels),
            covered / len(words) if words else 0.0, sorted(spans, key=lambda s: (s["start"], s["label"])),
        )


def scan_licenses(frame: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word count, phrase places, labels, matched template spans (words from 0).

    score: the share of the words that licence wording covers.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    Scanner(templates, phrases)  # a bad template fails here, on the driver

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                rows = [scanner.scan(*row) for row in zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return texts(frame, id_col, text_col).mapInArrow(run, RESULT)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLE_SQL: dict[str, str] = {}
