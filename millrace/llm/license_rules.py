"""License scans: ordered signature rules.

Hundreds of patterns, each with a label, a priority, a weight and a keyword. A text is first
searched for the keywords; only the rules of keywords that occur are run. Detections are resolved
in order of priority: one that lies inside the interval of a stronger one is dropped. Phrases of
the base rule are found apart from that and always stay.

Rules are written as short tables; names, versions and identifiers go through a few templates (tag,
address, grant, named version, name), so that a new license is one line. A version is always spelled
with its minor number in labels. Identifiers are found anywhere in a compound SPDX expression.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import wordscan as W

# --- Fixed values: phrases and labels of the base rule.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Words are runs of ASCII letters, digits and all characters from U+0080 on.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
WORD, GAP = r"[0-9a-z\x80-\xff]", r"[^0-9a-z\x80-\xff]+"

PRIORITY = {"tag": 100, "text": 95, "address": 90, "grant": 80, "version": 60, "name": 40, "notice": 20}
WEIGHT = {"tag": 1.0, "text": 0.95, "address": 0.9, "grant": 0.9, "version": 0.8, "name": 0.6, "notice": 0.3}
BASE_WEIGHT = 0.7

# label, keyword, name pattern, versions ("" for none), tag stem
FAMILIES = (
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", "1.0 2.0 3.0", "gpl"),
    ("gpl", "gpl", r"(?:gnu )?gpl", "1.0 2.0 3.0", ""),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "2.0 2.1 3.0", "lgpl"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "2.0 2.1 3.0", ""),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "1.0 3.0", "agpl"),
    ("agpl", "agpl", r"(?:gnu )?agpl", "3.0", ""),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", "1.1 1.2 1.3", "gfdl"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", "1.0 1.1 2.0", "apache"),
    ("mit", "mit", r"mit licen[cs]e", "", "mit"),
    ("mit", "expat", r"expat licen[cs]e", "", ""),
    ("x11", "x11", r"x11 licen[cs]e", "", "x11"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2-clause|two-clause) bsd licen[cs]e", "", "bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause|three-clause) bsd licen[cs]e", "", "bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4-clause|four-clause) bsd licen[cs]e", "", "bsd-4-clause"),
    ("0bsd", "bsd", r"(?:zero-clause|0-clause) bsd licen[cs]e", "", "0bsd"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[cs]e", "", ""),
    ("mpl", "mozilla public", r"mozilla public licen[cs]e", "1.0 1.1 2.0", "mpl"),
    ("epl", "eclipse public", r"eclipse public licen[cs]e", "1.0 2.0", "epl"),
    ("cpl", "common public", r"common public licen[cs]e", "1.0", "cpl"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", "1.0 1.1", "cddl"),
    ("eupl", "european union public", r"european union public licen[cs]e", "1.0 1.1 1.2", "eupl"),
    ("artistic", "artistic", r"artistic licen[cs]e", "1.0 2.0", "artistic"),
    ("isc", "isc", r"isc licen[cs]e", "", "isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", "", "zlib"),
    ("boost", "boost software", r"boost software licen[cs]e", "1.0", "bsl"),
    ("unlicense", "unlicense", r"the unlicense", "", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "2.0", "wtfpl"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", "1.0 1.1", "ofl"),
    ("osl", "open software", r"open software licen[cs]e", "1.0 2.0 2.1 3.0", "osl"),
    ("afl", "academic free", r"academic free licen[cs]e", "1.1 1.2 2.0 2.1 3.0", "afl"),
    ("odbl", "open database", r"open (?:data commons )?database licen[cs]e", "1.0", "odbl"),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", "1.0", "odc-by"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[cs]e", "1.0", "pddl"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", "", "ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", "", "ms-rl"),
    ("ecl", "educational community", r"educational community licen[cs]e", "1.0 2.0", "ecl"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[cs]e", "", "ncsa"),
    ("psf", "python", r"python (?:software foundation )?licen[cs]e", "2.0", "python"),
    ("php", "php", r"php licen[cs]e", "3.0 3.01", "php"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "", "postgresql"),
    ("openssl", "openssl", r"openssl licen[cs]e", "", "openssl"),
    ("ruby", "ruby", r"ruby licen[cs]e", "", "ruby"),
    ("vim", "vim", r"vim licen[cs]e", "", "vim"),
    ("qpl", "q public", r"q public licen[cs]e", "1.0", "qpl"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", "1.0", "upl"),
    ("mulan", "mulan", r"mulan permissive software licen[cs]e", "1.0 2.0", "mulanpsl"),
    ("cecill", "cecill", r"cecill(?:-[bc])?(?: licen[cs]e)?", "1.0 2.0 2.1", "cecill"),
    ("sspl", "server side public", r"server side public licen[cs]e", "1.0", "sspl"),
    ("busl", "business source", r"business source licen[cs]e", "1.1", "busl"),
    ("elastic", "elastic", r"elastic licen[cs]e", "2.0", "elastic"),
    ("openrail", "openrail", r"(?:bigscience )?openrail(?:-m)?(?: licen[cs]e)?", "", ""),
)

CC_PARTS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_WORDS = {"by": "attribution", "sa": "share-?alike", "nd": "no-?deriv(?:ative)?s", "nc": "non-?commercial"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Short spellings that name a license only together with a version.
# label, keyword, name pattern, versions
SHORT_NAMES = (
    ("apache", "apache", r"apache", "1.0 1.1 2.0"),
    ("mpl", "mpl", r"mpl", "1.0 1.1 2.0"),
    ("epl", "epl", r"epl", "1.0 2.0"),
    ("cddl", "cddl", r"cddl", "1.0 1.1"),
    ("eupl", "eupl", r"eupl", "1.0 1.1 1.2"),
    ("gfdl", "gfdl", r"(?:gnu )?g?fdl", "1.1 1.2 1.3"),
    ("ofl", "ofl", r"(?:sil )?ofl", "1.0 1.1"),
    ("boost", "bsl", r"bsl", "1.0"),
    ("busl", "bsl", r"bu?sl", "1.1"),
)

# label, keyword, characteristic sentence
TEXTS = (
    ("mit", "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software"),
    ("isc", "permission to use", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee"),
    ("mit", "without restriction", r"to deal in the software without restriction,? including without limitation the rights to use"),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the (?:above )?copyright notice,? this list of conditions"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the (?:above )?copyright notice,? this list of conditions"),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "copyright holders and contributors", r"this software is provided by the copyright holders and contributors (?:\"as is\"|''as is''|``as is'')"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("epl", "eclipse public", r"made available under the terms of the eclipse public licen[cs]e"),
    ("epl", "acceptance of this agreement", r"any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement"),
    ("mpl", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", "mpl was not", r"if a copy of the mpl was not distributed with this file"),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("gpl", "general public", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    ("gfdl", "free documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("apache", "apache", r"terms and conditions for use, reproduction,? and distribution"),
    ("cc", "creative commons", r"creative commons corporation is not a law firm"),
    ("cc", "licensed rights", r"by exercising the licensed rights \(defined below\),? you accept and agree to be bound"),
    ("odbl", "open database", r"this database is made available under the open database licen[cs]e"),
    ("ofl", "reserved font", r"no modified version of the font software may use the reserved font name"),
    ("wtfpl", "do what the", r"you just do what the f\W?\w+ you want to"),
    ("gpl", "redistribute it", r"you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "redistribute it", r"you can redistribute it and/or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("agpl", "redistribute it", r"you can redistribute it and/or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("apache", "you may not use this file", r"you may not use this file except in compliance with the licen[cs]e"),
    ("mpl", "mozilla public", r"subject to the terms of the mozilla public licen[cs]e"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("boost", "boost software", r"distributed under the boost software licen[cs]e"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the", r"do what the f\W?\w+ you want to public licen[cs]e"),
    ("cc0", "waived all copyright", r"waived all copyright and related or neighboring rights"),
    ("public-domain", "public domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain"),
)

# label, keyword, address without scheme
ADDRESSES = (
    ("apache", "apache.org", r"apache\.org/licen[cs]es/licen[cs]e-(?:1\.[01]|2\.0)"),
    ("gpl", "gnu.org", r"gnu\.org/licen[cs]es/(?:old-licen[cs]es/)?gpl"),
    ("lgpl", "gnu.org", r"gnu\.org/licen[cs]es/(?:old-licen[cs]es/)?lgpl"),
    ("agpl", "gnu.org", r"gnu\.org/licen[cs]es/agpl"),
    ("gfdl", "gnu.org", r"gnu\.org/licen[cs]es/(?:old-licen[cs]es/)?fdl"),
    ("mit", "opensource.org", r"opensource\.org/licen[cs]es?/mit"),
    ("bsd", "opensource.org", r"opensource\.org/licen[cs]es?/bsd"),
    ("mpl", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", "eclipse.org", r"eclipse\.org/(?:legal|org/documents)/epl"),
    ("cc0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero"),
    ("public-domain", "creativecommons.org", r"creativecommons\.org/publicdomain/mark"),
    ("odbl", "opendatacommons.org", r"opendatacommons\.org/licen[cs]es/odbl"),
    ("odc-by", "opendatacommons.org", r"opendatacommons\.org/licen[cs]es/by"),
    ("pddl", "opendatacommons.org", r"opendatacommons\.org/licen[cs]es/pddl"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("ofl", "scripts.sil.org", r"scripts\.sil\.org/ofl"),
)

# label, keyword, pattern of a notice that names no license text
NOTICES = (
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("public-domain", "public domain", r"public domain"),
    ("cc", "creative commons", r"creative commons(?: licen[cs]e)?"),
    ("cc0", "cc0", r"cc0(?: 1\.0)?(?: universal)?"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|licen[cs]e)"),
    ("proprietary", "commercial licen", r"commercial licen[cs]e"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keyword: bytes
    pattern: re.Pattern

    @property
    def priority(self) -> int:
        return PRIORITY[self.kind]


#: What a blank in a pattern stands for: white space, hyphens and the frames of comments.
BLANK = r"(?:[\s\-*/#;%>|]{1,24})"


def rule(label: str, kind: str, keyword: str, pattern: str) -> Rule:
    """A match begins and ends at word limits. A group named ``id`` is what counts as the place."""
    body = pattern.replace(" ", BLANK)
    return Rule(label, kind, keyword.encode(), re.compile(rf"(?<!{WORD}){body}(?!{WORD})".encode("latin-1")))


def version_pattern(version: str) -> str:
    number = re.escape(version).replace(r"\.0", r"(?:\.0)?") if version.endswith(".0") else re.escape(version)
    return rf"(?:,? ?(?:version|ver\.?|v\.?))? ?{number}(?:\+| or later)?(?!\.?[0-9])"


def tag(identifier: str) -> str:
    """An identifier anywhere in the expression after an SPDX label; at most eight stand before it."""
    return rf"spdx-licen[cs]e-identifier: ?(?:\(*[\w.+\-]+\)* (?:or|and|with) ){{0,8}}\(*(?P<id>{identifier})"


@lru_cache(maxsize=1)
def default_rules() -> tuple[Rule, ...]:
    """The expanded rules, strongest first; equal priorities keep the order of the tables."""
    out = []
    for label, keyword, name, versions, stem in FAMILIES:
        for version in versions.split():
            named = f"{label}-{version}"
            out.append(rule(named, "version", keyword, name + version_pattern(version)))
            out.append(rule(named, "grant", keyword, rf"licen[cs]ed under (?:the )?(?:terms of the )?{name}{version_pattern(version)}"))
            if stem:
                out.append(rule(named, "tag", "spdx-licen", tag(rf"{stem}-{re.escape(version)}(?:-only|-or-later|\+)?")))
        if stem and not versions:
            out.append(rule(label, "tag", "spdx-licen", tag(stem)))
        out.append(rule(label, "grant", keyword, rf"licen[cs]ed under (?:the )?(?:terms of the )?{name}"))
        out.append(rule(label, "name", keyword, name))
    for parts in CC_PARTS:
        spelled = r",? ?".join(CC_WORDS[p] for p in parts.split("-"))
        short = r"[\s\-]?".join(parts.split("-"))
        for version in CC_VERSIONS:
            label = f"cc-{parts}-{version}"
            out.append(rule(label, "tag", "spdx-licen", tag(rf"cc-{parts}-{re.escape(version)}")))
            out.append(rule(label, "address", "creativecommons.org", rf"creativecommons\.org/licen[cs]es/{parts}/{re.escape(version)}"))
            out.append(rule(label, "version", "cc", rf"cc[\s\-]{short}[\s\-]{re.escape(version)}"))
            out.append(rule(label, "version", "creative commons", rf"creative commons {spelled} {re.escape(version)}"))
        out.append(rule(f"cc-{parts}", "address", "creativecommons.org", rf"creativecommons\.org/licen[cs]es/{parts}"))
        out.append(rule(f"cc-{parts}", "name", "cc", rf"cc[\s\-]{short}"))
        out.append(rule(f"cc-{parts}", "name", "creative commons", rf"creative commons {spelled}"))
    for label, keyword, name, versions in SHORT_NAMES:
        out += [rule(f"{label}-{v}", "version", keyword, name + version_pattern(v)) for v in versions.split()]
    out += [rule(label, "text", keyword, pattern) for label, keyword, pattern in TEXTS]
    out += [rule(label, "address", keyword, pattern) for label, keyword, pattern in ADDRESSES]
    out += [rule(label, "notice", keyword, pattern) for label, keyword, pattern in NOTICES]
    return tuple(sorted(out, key=lambda r: -r.priority))


def gates(rules: tuple[Rule, ...]) -> dict[tuple[bytes, ...], list[int]]:
    """Rule numbers by the words of their keyword; whatever stands between the words, all must occur."""
    out: dict[tuple[bytes, ...], list[int]] = {}
    for i, r in enumerate(rules):
        out.setdefault(tuple(r.keyword.split()), []).append(i)
    return out


def detections(text: bytes, rules: tuple[Rule, ...], by_keyword: dict[tuple[bytes, ...], list[int]]) -> list[tuple[int, int, Rule]]:
    """``(start, end, rule)`` that no stronger detection contains. Of equal priorities the longer
    one counts as stronger, then the earlier rule."""
    wanted = sorted(i for words, own in by_keyword.items() if all(w in text for w in words) for i in own)
    found = [(*m.span("id" if rules[i].kind == "tag" else 0), i) for i in wanted for m in rules[i].pattern.finditer(text)]
    found.sort(key=lambda x: (-rules[x[2]].priority, x[0] - x[1], x[0], x[2]))
    kept: list[tuple[int, int, Rule]] = []
    for start, end, i in suppressed(found):
        kept.append((start, end, rules[i]))
    return sorted(kept, key=lambda x: (x[0], x[1]))


def suppressed(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Drop what lies inside an earlier (stronger) interval. Kept intervals contain none another,
    except a weaker one around a stronger; the furthest end at or before a start decides."""
    kept, hull = [], []  # hull: (start, end) of kept intervals, no one inside another
    for item in found:
        start, end, _ = item
        at = bisect_right(hull, (start, float("inf")))
        if at and hull[at - 1][1] >= end:
            continue
        kept.append(item)
        # Intervals inside the new one no longer matter for containment.
        to = at
        while to < len(hull) and hull[to][1] <= end:
            to += 1
        low = at - 1 if at and hull[at - 1][0] == start else at
        del hull[low:to]
        insort(hull, (start, end))
    return kept


def phrase_patterns() -> list[tuple[re.Pattern, str]]:
    return [
        (re.compile(rf"(?<!{WORD}){GAP.join(phrase.split())}(?!{WORD})".encode("latin-1")), label)
        for phrase, label in BASE_PHRASES
    ]


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(n, T.StringType()) for n in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType()), T.StructField("n_detections", T.LongType())]
)


def licenses(text: Column, rules: tuple[Rule, ...] | None = None) -> Column:
    """Struct of base places, labels and score for a text column (see ``RESULT``).

    Only A-Z are lower-cased. Null and empty texts have no words, no places, empty labels and
    score 0. The score is the strongest weight of a remaining detection or base place.
    Whole texts are read; equal rows get equal results.
    """

    @F.arrow_udf(RESULT)
    def scanned(column: pa.Array) -> pa.Array:
        # The rules are rebuilt on the worker once, not shipped with every task.
        own = rules or default_rules()
        by_keyword, phrases = gates(own), phrase_patterns()
        out = {name: [] for name in RESULT.names}
        for _, data, bounds in W.slices(column):
            raw = data.tobytes().lower()
            words = W.find_words(np.frombuffer(raw, dtype=np.uint8), bounds, NOT_WORD)
            out["n_words"] += words.counts.tolist()
            for d, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                text = raw[s:e]
                places = [(m.start(), label) for pattern, label in phrases for m in pattern.finditer(text)]
                base = {label for _, label in places}
                kept = detections(text, own, by_keyword)
                first = int(words.first[d])
                index = [int(np.searchsorted(words.starts, s + p)) - first for p in (min(places)[0], max(places)[0])] if places else [None, None]
                out["n_base"].append(len(places))
                out["first_word"].append(index[0])
                out["last_word"].append(index[1])
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {r.label for _, _, r in kept})))
                out["score"].append(max([BASE_WEIGHT if places else 0.0, *(WEIGHT[r.kind] for _, _, r in kept)]))
                out["n_detections"].append(len(kept))
        kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
        return pa.StructArray.from_arrays([pa.array(out[f.name], kinds[f.dataType]) for f in RESULT.fields], names=RESULT.names)

    return scanned.asNondeterministic()(text)


def with_licenses(df: DataFrame, text_col: str = "text", out: str = "license", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """All rows and columns of ``df`` and the struct ``out``; a column of that name is replaced."""
    return df.withColumn(out, licenses(F.col(f"`{text_col}`"), rules))
