"""License scan: ordered signature rules with a keyword gate and interval suppression.

A text is lower-cased (A-Z), cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` and
joined again by single spaces; the rules are regular expressions over that
form, so line breaks and punctuation do not matter. Rules are ordered by
priority: identifier tags, then full-notice signatures, then "licensed under
..." phrases, then versioned names, then bare names. A rule is tried only if its
keyword (part of a word) occurs and, for the rules of a license, one of the license's own
words ("mozilla public", "epl", ...); a text is normalised only if any keyword occurs.

A detection whose words lie within those of a detection of higher priority (or of
equal priority that is longer, or comes first) is suppressed. The base phrases
are rules of their own: they are always found and never suppressed.

Edge cases: null and wordless texts have no detections; overlapping places of one
rule all count for base phrases; repeated rows are scanned alike.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import ALNUM, LOWER, blocks, bounded_batches, text_buffer, without

# The base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Label; name in normalised words (a regular expression); versions (or none); identifier words.
LICENSES = """
mit ; (?:the )?mit(?: expat)? ; ; mit
mit-0 ; mit no attribution ; ; mit 0
apache ; (?:the )?apache(?: software)? ; 1 0, 1 1, 2 0 ; apache
gpl ; (?:the )?(?:gnu )?(?:gpl|general public) ; 1, 2, 3, 1 0, 2 0, 3 0 ; gpl
lgpl ; (?:the )?(?:gnu )?(?:lgpl|lesser general public|library general public) ; 2, 3, 2 0, 2 1, 3 0 ; lgpl
agpl ; (?:the )?(?:gnu )?(?:agpl|affero general public) ; 1, 3, 1 0, 3 0 ; agpl
gfdl ; (?:the )?(?:gnu )?(?:gfdl|fdl|free documentation) ; 1 1, 1 2, 1 3 ; gfdl
bsd-2-clause ; (?:the )?(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) ; ; bsd 2 clause
bsd-3-clause ; (?:the )?(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) ; ; bsd 3 clause
bsd-4-clause ; (?:the )?(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd) ; ; bsd 4 clause
bsd ; (?:the )?bsd(?: style)? ; ; bsd
0bsd ; (?:the )?(?:0bsd|bsd 0 clause|zero clause bsd) ; ; 0bsd
isc ; (?:the )?isc ; ; isc
mpl ; (?:the )?(?:mpl|mozilla public) ; 1 0, 1 1, 2 0 ; mpl
epl ; (?:the )?(?:epl|eclipse public) ; 1 0, 2 0 ; epl
cpl ; (?:the )?common public ; 0 5, 1 0 ; cpl
cddl ; (?:the )?(?:cddl|common development and distribution) ; 1 0, 1 1 ; cddl
eupl ; (?:the )?(?:eupl|european union public) ; 1 0, 1 1, 1 2 ; eupl
artistic ; (?:the )?(?:perl )?artistic ; 1 0, 2 0 ; artistic
zlib ; (?:the )?zlib(?: libpng)? ; ; zlib
libpng ; (?:the )?libpng ; 1 6 35, 2 0 ; libpng
bsl ; (?:the )?(?:boost software|boost) ; 1 0 ; bsl
unlicense ; (?:the )?unlicense ; ; unlicense
wtfpl ; (?:the )?(?:wtfpl|do what the fuck you want to public) ; 1, 2 ; wtfpl
cc0 ; (?:the )?(?:cc0|cc zero|creative commons zero) ; 1 0 ; cc0
cc-by ; (?:the )?(?:cc by|creative commons attribution) ; 1 0, 2 0, 2 5, 3 0, 4 0 ; cc by
cc-by-sa ; (?:the )?(?:cc by sa|creative commons attribution share ?alike) ; 1 0, 2 0, 2 5, 3 0, 4 0 ; cc by sa
cc-by-nc ; (?:the )?(?:cc by nc|creative commons attribution non ?commercial) ; 1 0, 2 0, 2 5, 3 0, 4 0 ; cc by nc
cc-by-nd ; (?:the )?(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?) ; 1 0, 2 0, 2 5, 3 0, 4 0 ; cc by nd
cc-by-nc-sa ; (?:the )?(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) ; 1 0, 2 0, 2 5, 3 0, 4 0 ; cc by nc sa
cc-by-nc-nd ; (?:the )?(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?) ; 1 0, 2 0, 2 5, 3 0, 4 0 ; cc by nc nd
odbl ; (?:the )?(?:odbl|open database|odc open database) ; 1 0 ; odbl
odc-by ; (?:the )?(?:odc by|open data commons attribution) ; 1 0 ; odc by
pddl ; (?:the )?(?:pddl|public domain dedication and) ; 1 0 ; pddl
ofl ; (?:the )?(?:sil )?(?:ofl|open font) ; 1 0, 1 1 ; ofl
psf ; (?:the )?(?:psf|python software foundation|python) ; 2, 2 0 ; psf
php ; (?:the )?php ; 3 0, 3 01 ; php
ruby ; (?:the )?ruby ; ; ruby
postgresql ; (?:the )?postgresql ; ; postgresql
openssl ; (?:the )?openssl ; ; openssl
x11 ; (?:the )?x11 ; ; x11
ncsa ; (?:the )?(?:ncsa|university of illinois ncsa open source) ; ; ncsa
afl ; (?:the )?academic free ; 1 1, 2 0, 2 1, 3 0 ; afl
osl ; (?:the )?open software ; 1 0, 2 0, 2 1, 3 0 ; osl
rpl ; (?:the )?reciprocal public ; 1 1, 1 5 ; rpl
qpl ; (?:the )?q public ; 1 0 ; qpl
cecill ; (?:the )?cecill ; 1 0, 1 1, 2 0, 2 1 ; cecill
ms-pl ; (?:the )?(?:ms pl|microsoft public) ; ; ms pl
ms-rl ; (?:the )?(?:ms rl|microsoft reciprocal) ; ; ms rl
upl ; (?:the )?universal permissive ; 1 0 ; upl
vim ; (?:the )?vim ; ; vim
sleepycat ; (?:the )?sleepycat ; ; sleepycat
sspl ; (?:the )?(?:sspl|server side public) ; 1, 1 0 ; sspl
busl ; (?:the )?(?:busl|business source) ; 1 0, 1 1 ; busl
elastic ; (?:the )?elastic ; 2 0 ; elastic
mulan ; (?:the )?mulan(?: permissive software| psl)? ; 1, 2 ; mulanpsl
blueoak ; (?:the )?blue oak model ; 1 0 0 ; blueoak
openrail ; (?:the )?(?:creativeml )?(?:open )?(?:rail m|openrail m?) ; ; openrail
"""

# Label; signature in normalised words (a regular expression); keyword.
NOTICES = """
mit ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ; granted
mit ; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability ; merchantability
isc ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted ; granted
bsd ; redistribution and use in source and binary forms with or without modification are permitted ; redistribution
bsd-3-clause ; neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products ; endorse
bsd-4-clause ; all advertising materials mentioning features or use of this software must display ; advertising
gpl ; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license ; redistribute
gpl ; either version [123] of the license or at your option any later version ; option
gpl ; you should have received a copy of the gnu general public license along with ; received
lgpl ; you should have received a copy of the gnu lesser general public license along with ; received
lgpl ; this library is free software you can redistribute it and or modify it ; redistribute
agpl ; you should have received a copy of the gnu affero general public license along with ; received
apache ; licensed to the apache software foundation asf under one or more contributor license agreements ; contributor
apache ; you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org ; compliance
apache ; www apache org licenses license 2 0 ; apache
mpl ; this source code form is subject to the terms of the mozilla public license ; mozilla
mpl ; if a copy of the mpl was not distributed with this file ; distributed
epl ; this program and the accompanying materials are made available under the terms of the eclipse public license ; accompanying
cddl ; the contents of this file are subject to the terms of the common development and distribution license ; contents
unlicense ; this is free and unencumbered software released into the public domain ; unencumbered
wtfpl ; you just do what the fuck you want to ; fuck
zlib ; this software is provided as is without any express or implied warranty in no event will the authors be held liable ; liable
bsl ; permission is hereby granted free of charge to any person or organization obtaining a copy of the software ; granted
cc-by-sa ; creativecommons org licenses by sa ; creativecommons
cc-by-nc ; creativecommons org licenses by nc(?! sa| nd) ; creativecommons
cc-by-nd ; creativecommons org licenses by nd ; creativecommons
cc-by-nc-sa ; creativecommons org licenses by nc sa ; creativecommons
cc-by-nc-nd ; creativecommons org licenses by nc nd ; creativecommons
cc-by ; creativecommons org licenses by(?! sa| nc| nd) ; creativecommons
cc0 ; creativecommons org publicdomain zero ; creativecommons
public-domain ; (?:released|placed|dedicated) (?:in|into|to) the public domain ; domain
public-domain ; this work is in the public domain ; domain
ofl ; this font software is licensed under the sil open font license ; licen
odbl ; opendatacommons org licenses odbl ; opendatacommons
proprietary ; all rights reserved no part of this .{1,60}? may be reproduced ; reproduced
proprietary ; proprietary and confidential ; confidential
proprietary ; unauthorized copying of this file via any medium is strictly prohibited ; unauthorized
"""


class Rule(NamedTuple):
    priority: int  # lower goes first
    label: str
    kind: str
    keyword: str
    pattern: re.Pattern
    confidence: float
    words: tuple[str, ...] = ()  # of the license's name: one of them is in every match


def literals(pattern: str) -> tuple[str, ...]:
    """Strings of which every match of a name pattern holds one: of each alternative, optional parts left out, the longest plain run.

    A run that is a whole alternative stands between spaces, so it gets them.
    """
    while (short := re.sub(r"\(\?:[^()]*\)\?", "\0", pattern)) != pattern:
        pattern = short
    while m := re.search(r"\(\?:([^()]*)\)", pattern):  # one group at a time: its alternatives within what stands around it
        return tuple(x for alt in m[1].split("|") for x in literals(pattern[: m.start()] + alt + pattern[m.end() :]))
    runs = re.split(r"\0|.\?", pattern)
    best = max(runs, key=len)
    return (f" {best.strip()} " if len([r for r in runs if r]) == 1 and "?" not in pattern else best,)


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """All rules in order: the notices, and for each license its tag, phrase and name rules."""
    out = []
    # words are what single spaces separate: other white space belongs to them
    word = lambda p: re.compile(rf"(?<![^ ])(?:{p})(?![^ ])")

    rows = lambda table: [[c.strip() for c in line.split(";")] for line in table.strip().splitlines()]
    for label, signature, keyword in rows(NOTICES):
        out.append(Rule(1, label, "notice", keyword, word(signature), 1.0))
    terms = r"(?:under|subject to|governed by|in accordance with)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"
    verb = r"(?:licensed|released|distributed|available|published|provided|covered|redistributable|dual licensed|shared)"
    for label, name, versions, tag in rows(LICENSES):
        own = literals(name)
        numbers = [v.strip() for v in versions.split(",") if v.strip()]
        anyv = f"(?: (?:version|v)?(?: )?(?:{'|'.join(numbers)}))?" if numbers else ""
        lic = "(?: licen[cs]es?)?"
        out.append(Rule(0, label, "tag", "spdx", word(f"spdx license identifier {tag}(?: (?:{'|'.join(numbers)}))?(?: only| or later)?" if numbers else f"spdx license identifier {tag}"), 1.0))
        out.append(Rule(2, label, "grant", "licen", word(f"{verb} {terms} {name}{anyv}{lic}{anyv}"), 0.95, own))
        out.append(Rule(3, label, "field", "licen", word(f"licen[cs]es? (?:type |name |is |under |the )?{name}{anyv}"), 0.8, own))
        for v in numbers:
            out.append(Rule(4, label, "version", "licen", word(f"{name} licen[cs]e (?:version |v ?)?{v}"), 0.9, own))
        out.append(Rule(5, label, "name", "licen", word(f"{name} licen[cs]e"), 0.75, own))
    for phrase, label in BASE:
        out.append(Rule(6, label, "base", "licen", word(phrase), 0.75))
    return sorted(out, key=lambda r: r.priority)


@lru_cache(maxsize=1)
def gate() -> list[bytes]:
    """The rules' keywords: a text without any of them is passed over."""
    return sorted({r.keyword.encode() for r in rules()})


class Found(NamedTuple):
    label: str
    kind: str
    priority: int
    first: int
    past: int
    confidence: float


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def detect(raw: bytes) -> tuple[list[Found], list[Found]]:
    """Base detections and surviving detections of one text (UTF-8)."""
    low = raw.lower()  # bytes: A-Z only
    if not any(k in low for k in gate()):
        return [], []
    tokens = _WORD.findall(low)
    text = b" ".join(tokens).decode("utf-8", "replace")
    starts = np.concatenate([[0], np.cumsum([len(w.decode("utf-8", "replace")) + 1 for w in tokens])]).tolist()
    found, base = [], []
    present: dict[str, bool] = {}
    spaced = f" {text} "

    def there(word: str) -> bool:
        if word not in present:
            present[word] = word in spaced
        return present[word]

    for r in rules():
        if not there(r.keyword) or r.words and not any(map(there, r.words)):
            continue
        for m in r.pattern.finditer(text):
            x = Found(r.label, r.kind, r.priority, bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1), r.confidence)
            (base if r.kind == "base" else found).append(x)
    return base, _unsuppressed(found + base, len(tokens))


def _unsuppressed(found: list[Found], n: int) -> list[Found]:
    """Detections that lie within none that goes before them, by one sweep: a tree of the farthest end by start answers each in log n steps."""
    kept: list[Found] = []
    far = [0] * (n + 2)  # far[i]: the farthest end of kept detections that start in the i-th range of a Fenwick tree
    for x in sorted(found, key=lambda x: (x.priority, x.first - x.past, x.first)):
        i, end = x.first + 1, 0
        while i > 0:
            end = max(end, far[i])
            i &= i - 1
        if end >= x.past:
            continue
        kept.append(x)
        i = x.first + 1
        while i < len(far):
            far[i] = max(far[i], x.past)
            i += i & -i
    return kept


def word_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The number of words of every text."""
    isw = ALNUM[LOWER[buf]]
    first = isw.copy()
    first[1:] &= ~isw[:-1]
    begin = offs[:-1][offs[:-1] < offs[1:]]
    first[begin] = isw[begin]
    c = np.concatenate([[0], np.cumsum(first)])
    return c[offs[1:]] - c[offs[:-1]]


_FOUND = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("priority", pa.int32()), ("first", pa.int64()), ("past", pa.int64()), ("confidence", pa.float64())]))
_FOUND_SQL = "array<struct<label:string,kind:string,priority:int,first:long,past:long,confidence:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with n_words, base (all places of base phrases) and detections (those that are not suppressed)."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, "n_words", "base", "detections")
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            n, base, kept = [], [], []
            for i0, i1 in blocks(offs, 4 << 20):
                part, po = buf[offs[i0] : offs[i1]], offs[i0 : i1 + 1] - offs[i0]
                n.append(word_counts(part, po))
                raw = part.tobytes()
                for a, b in zip(po[:-1].tolist(), po[1:].tolist(), strict=True):
                    x, y = detect(raw[a:b])
                    base.append([f._asdict() for f in x])
                    kept.append([f._asdict() for f in y])
            count = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(count), pa.array(base, _FOUND), pa.array(kept, _FOUND)], names=[*names, "n_words", "base", "detections"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return docs.mapInArrow(run, f"{fields + ', ' if fields else ''}n_words long, base {_FOUND_SQL}, detections {_FOUND_SQL}")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    from pyspark.sql import functions as F

    rows = scan(docs.select("doc_id", "text"))
    names = lambda c: F.array_distinct(F.transform(c, lambda x: x["label"]))
    starts = F.transform("base", lambda x: x["first"])
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.concat_ws(",", F.array_sort(names("base"))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(names("base"), names("detections")))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
    )
