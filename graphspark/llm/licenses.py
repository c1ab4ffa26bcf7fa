"""License scan: ordered signature rules behind a keyword filter, overlaps resolved by priority."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A-Z become a-z, ASCII digits and a-z and all bytes of other characters stay, the rest parts words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

#: Phrases whose places every scan reports, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    """A signature over words joined by one space: label, priority, relevance, keyword, pattern.

    The pattern runs only where the keyword, a word that every match holds, occurs in the text.
    """

    label: str
    priority: int
    relevance: float
    keyword: str
    pattern: str


#: label | priority | relevance | keyword | pattern. A space stands for a word boundary.
_SIGNATURES = r"""
apache-2.0 | 90 | 1.0 | apache | licensed under (?:the )?apache (?:software )?license (?:version |v ?)?2(?: 0)?
apache-2.0 | 90 | 1.0 | apache | licensed under the terms of the apache (?:software )?license (?:version |v ?)?2(?: 0)?
apache-2.0 | 80 | 0.9 | apache | apache (?:software )?license (?:version |v ?)?2(?: 0)?
apache-2.0 | 80 | 0.9 | apache | apache 2(?: 0)? licen[cs]ed?
apache-2.0 | 80 | 0.9 | apache | apache org licenses license 2 0
apache-1.1 | 80 | 0.9 | apache | apache (?:software )?license (?:version |v ?)?1 1
apache-1.0 | 80 | 0.9 | apache | apache (?:software )?license (?:version |v ?)?1 0
apache | 40 | 0.5 | apache | apache (?:software |public )?license
mit | 90 | 1.0 | mit | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | 80 | 0.9 | mit | (?:the )?mit licen[cs]e
mit | 80 | 0.9 | mit | mit x11 licen[cs]e
mit | 70 | 0.9 | charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 60 | 0.7 | noninfringement | fitness for a particular purpose and noninfringement
mit-0 | 95 | 1.0 | mit | mit no attribution
mit-cmu | 85 | 0.9 | cmu | (?:mit )?cmu licen[cs]e
expat | 80 | 0.9 | expat | expat licen[cs]e
x11 | 80 | 0.9 | x11 | x11 (?:style )?licen[cs]e
gpl-1.0 | 90 | 1.0 | general | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?version 1
gpl-2.0 | 90 | 1.0 | general | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2(?: 0)?
gpl-2.0-or-later | 95 | 1.0 | general | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?version 2 of the licen[cs]e or at your option any later version
gpl-3.0 | 90 | 1.0 | general | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?
gpl-3.0-or-later | 95 | 1.0 | general | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?version 3 of the licen[cs]e or at your option any later version
gpl-2.0 | 85 | 0.9 | gpl | gnu gpl (?:version |v ?)2(?: 0)?
gpl-3.0 | 85 | 0.9 | gpl | gnu gpl (?:version |v ?)3(?: 0)?
gpl-2.0 | 80 | 0.8 | gplv2 | gplv2
gpl-3.0 | 80 | 0.8 | gplv3 | gplv3
gpl-2.0 | 80 | 0.8 | gpl2 | gpl2
gpl-3.0 | 80 | 0.8 | gpl3 | gpl3
gpl | 30 | 0.6 | gnu | gnu (?:general public licen[cs]e|gpl)
gpl | 30 | 0.6 | gpl | (?:under|of) the gpl
lgpl-2.0 | 92 | 1.0 | library | gnu library general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2(?: 0)?
lgpl-2.1 | 92 | 1.0 | lesser | (?:gnu )?lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2 1
lgpl-3.0 | 92 | 1.0 | lesser | (?:gnu )?lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?
lgpl-2.1 | 80 | 0.8 | lgpl | (?:gnu )?lgpl (?:version |v ?)2 1
lgpl-3.0 | 80 | 0.8 | lgpl | (?:gnu )?lgpl (?:version |v ?)3(?: 0)?
lgpl | 50 | 0.6 | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | 50 | 0.6 | library | gnu library general public licen[cs]e
lgpl | 40 | 0.6 | lgpl | (?:gnu )?lgpl
agpl-3.0 | 92 | 1.0 | affero | (?:gnu )?affero general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?
agpl-1.0 | 92 | 1.0 | affero | affero general public licen[cs]e (?:version |v ?)1(?: 0)?
agpl-3.0 | 80 | 0.8 | agpl | (?:gnu )?agpl (?:version |v ?)3(?: 0)?
agpl | 50 | 0.6 | affero | (?:gnu )?affero general public licen[cs]e
agpl | 40 | 0.6 | agpl | (?:gnu )?agpl
gfdl-1.1 | 90 | 1.0 | documentation | (?:gnu )?free documentation licen[cs]e version 1 1
gfdl-1.2 | 90 | 1.0 | documentation | (?:gnu )?free documentation licen[cs]e version 1 2
gfdl-1.3 | 90 | 1.0 | documentation | (?:gnu )?free documentation licen[cs]e version 1 3
gfdl | 60 | 0.8 | documentation | gnu free documentation licen[cs]e
gfdl | 50 | 0.7 | gfdl | gfdl
bsd-0-clause | 90 | 1.0 | bsd | (?:0|zero) clause bsd
bsd-2-clause | 90 | 1.0 | bsd | (?:2|two) clause bsd
bsd-3-clause | 90 | 1.0 | bsd | (?:3|three) clause bsd
bsd-4-clause | 90 | 1.0 | bsd | (?:4|four) clause bsd
bsd-2-clause | 90 | 1.0 | bsd | bsd (?:2|two) clause
bsd-3-clause | 90 | 1.0 | bsd | bsd (?:3|three) clause
bsd-4-clause | 90 | 1.0 | bsd | bsd (?:4|four) clause
bsd-2-clause | 85 | 0.9 | simplified | simplified bsd licen[cs]e
bsd-2-clause | 85 | 0.9 | freebsd | freebsd licen[cs]e
bsd-3-clause | 85 | 0.9 | revised | revised bsd licen[cs]e
bsd-3-clause | 85 | 0.9 | modified | modified bsd licen[cs]e
bsd-4-clause | 85 | 0.9 | original | original bsd licen[cs]e
bsd | 50 | 0.6 | bsd | bsd (?:style )?licen[cs]ed?
bsd | 55 | 0.8 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 55 | 0.8 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 65 | 0.8 | endorse | may (?:not )?be used to endorse or promote products derived from this software
bsd-4-clause | 65 | 0.8 | advertising | all advertising materials mentioning features or use of this software
bsd | 45 | 0.6 | redistribution | redistribution and use in source and binary forms
isc | 80 | 0.9 | isc | (?:the )?isc licen[cs]e
isc | 60 | 0.8 | hereby | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
0bsd | 85 | 0.9 | 0bsd | 0bsd
mpl-1.0 | 90 | 1.0 | mozilla | mozilla public licen[cs]e (?:version |v ?)?1 0
mpl-1.1 | 90 | 1.0 | mozilla | mozilla public licen[cs]e (?:version |v ?)?1 1
mpl-2.0 | 90 | 1.0 | mozilla | mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
mpl-2.0 | 80 | 0.9 | mpl | mpl (?:version |v ?)?2(?: 0)?
mpl-1.1 | 80 | 0.9 | mpl | mpl (?:version |v ?)?1 1
mpl | 50 | 0.6 | mozilla | mozilla public licen[cs]e
npl-1.1 | 80 | 0.9 | netscape | netscape public licen[cs]e (?:version |v ?)?1 1
npl | 50 | 0.6 | netscape | netscape public licen[cs]e
epl-1.0 | 90 | 1.0 | eclipse | eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
epl-2.0 | 90 | 1.0 | eclipse | eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
epl | 50 | 0.6 | eclipse | eclipse public licen[cs]e
edl-1.0 | 80 | 0.9 | eclipse | eclipse distribution licen[cs]e
cddl-1.0 | 90 | 1.0 | distribution | common development and distribution licen[cs]e (?:version |v ?)?1 0
cddl-1.1 | 90 | 1.0 | distribution | common development and distribution licen[cs]e (?:version |v ?)?1 1
cddl | 50 | 0.6 | distribution | common development and distribution licen[cs]e
cpl-1.0 | 80 | 0.9 | common | common public licen[cs]e (?:version |v ?)?1 0
cpl | 50 | 0.6 | common | common public licen[cs]e
ipl-1.0 | 80 | 0.9 | ibm | ibm public licen[cs]e
eupl-1.0 | 90 | 1.0 | european | european union public licen[cs]e (?:version |v ?)?1 0
eupl-1.1 | 90 | 1.0 | european | european union public licen[cs]e (?:version |v ?)?1 1
eupl-1.2 | 90 | 1.0 | european | european union public licen[cs]e (?:version |v ?)?1 2
eupl | 50 | 0.6 | european | european union public licen[cs]e
eupl | 50 | 0.6 | eupl | eupl
artistic-1.0 | 90 | 1.0 | artistic | (?:the )?(?:perl )?artistic licen[cs]e (?:version |v ?)?1 0
artistic-2.0 | 90 | 1.0 | artistic | (?:the )?artistic licen[cs]e (?:version |v ?)?2(?: 0)?
artistic | 50 | 0.6 | artistic | (?:the )?(?:clarified )?artistic licen[cs]e
perl | 50 | 0.7 | perl | same terms as perl(?: itself)?
ruby | 50 | 0.7 | ruby | (?:same terms as ruby|ruby licen[cs]e)
python-2.0 | 80 | 0.9 | python | python software foundation licen[cs]e
python-2.0 | 70 | 0.8 | psf | psf licen[cs]e
php-3.0 | 80 | 0.9 | php | php licen[cs]e (?:version |v ?)?3 0
php-3.01 | 80 | 0.9 | php | php licen[cs]e (?:version |v ?)?3 01
php | 50 | 0.6 | php | php licen[cs]e
zlib | 80 | 0.9 | zlib | zlib (?:libpng )?licen[cs]e
libpng | 80 | 0.9 | libpng | libpng licen[cs]e
zlib | 60 | 0.8 | misrepresented | the origin of this software must not be misrepresented
bsl-1.0 | 85 | 0.9 | boost | boost software licen[cs]e(?: version 1 0)?
busl-1.1 | 90 | 1.0 | business | business source licen[cs]e 1 1
busl | 60 | 0.8 | business | business source licen[cs]e
sspl-1.0 | 85 | 0.9 | side | server side public licen[cs]e
elastic-2.0 | 85 | 0.9 | elastic | elastic licen[cs]e (?:version |v ?)?2(?: 0)?
unlicense | 80 | 0.9 | unlicense | (?:the )?unlicense
unlicense | 75 | 0.9 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 85 | 0.9 | wtfpl | wtfpl
wtfpl | 85 | 0.9 | fuck | do what the fuck you want to public licen[cs]e
beerware | 80 | 0.9 | beer | (?:the )?beer ware licen[cs]e
beerware | 80 | 0.9 | beerware | beerware
postgresql | 80 | 0.9 | postgresql | postgresql licen[cs]e
openssl | 80 | 0.9 | openssl | openssl licen[cs]e
sleepycat | 80 | 0.9 | sleepycat | sleepycat licen[cs]e
qpl-1.0 | 80 | 0.9 | q | q public licen[cs]e
ncsa | 80 | 0.9 | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[cs]e
afl-3.0 | 90 | 1.0 | academic | academic free licen[cs]e (?:version |v ?)?3 0
afl | 50 | 0.6 | academic | academic free licen[cs]e
osl-3.0 | 90 | 1.0 | open | open software licen[cs]e (?:version |v ?)?3 0
osl | 50 | 0.6 | open | open software licen[cs]e
ecl-2.0 | 80 | 0.9 | educational | educational community licen[cs]e
ms-pl | 85 | 0.9 | microsoft | microsoft public licen[cs]e
ms-rl | 85 | 0.9 | microsoft | microsoft reciprocal licen[cs]e
ofl-1.1 | 90 | 1.0 | font | (?:sil )?open font licen[cs]e (?:version |v ?)?1 1
ofl | 60 | 0.8 | font | (?:sil )?open font licen[cs]e
odbl-1.0 | 85 | 0.9 | database | open database licen[cs]e
odc-by-1.0 | 85 | 0.9 | commons | open data commons attribution licen[cs]e
pddl-1.0 | 85 | 0.9 | commons | open data commons public domain dedication
cdla-permissive | 85 | 0.9 | community | community data licen[cs]e agreement permissive
cdla-sharing | 85 | 0.9 | community | community data licen[cs]e agreement sharing
ogl-uk | 80 | 0.9 | open | open government licen[cs]e(?: version [123] 0)?
etalab | 80 | 0.9 | ouverte | licence ouverte
cecill-2.1 | 90 | 1.0 | cecill | (?:licence )?cecill (?:version |v ?)?2 1
cecill-b | 88 | 0.9 | cecill | cecill b
cecill-c | 88 | 0.9 | cecill | cecill c
cecill | 50 | 0.7 | cecill | cecill
vim | 70 | 0.9 | vim | vim licen[cs]e
curl | 70 | 0.9 | curl | curl licen[cs]e
ijg | 70 | 0.9 | jpeg | independent jpeg group
unicode | 70 | 0.9 | unicode | unicode (?:inc )?licen[cs]e agreement
w3c | 80 | 0.9 | w3c | w3c software (?:notice and )?(?:document )?licen[cs]e
upl-1.0 | 80 | 0.9 | universal | universal permissive licen[cs]e
mulan-2.0 | 80 | 0.9 | mulan | mulan (?:psl|permissive software licen[cs]e)(?: v ?2)?
json | 75 | 0.9 | evil | software shall be used for good not evil
hippocratic | 80 | 0.9 | hippocratic | hippocratic licen[cs]e
openrail-m | 85 | 0.9 | openrail | (?:creativeml |bigscience )?openrail m?
rail | 80 | 0.9 | responsible | responsible ai licen[cs]e
llama-community | 80 | 0.9 | llama | llama (?:[23] )?community licen[cs]e
cc0-1.0 | 92 | 1.0 | cc0 | cc0(?: 1 0)?
cc0-1.0 | 92 | 1.0 | zero | creative commons zero(?: 1 0)?
cc-pdm-1.0 | 85 | 0.9 | mark | public domain mark
public-domain | 60 | 0.8 | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 50 | 0.7 | domain | this work is in the public domain
creative-commons | 30 | 0.5 | creative | creative commons licen[cs]ed?
creative-commons | 35 | 0.6 | creativecommons | creativecommons org licenses
reserved | 20 | 0.6 | reserved | alle rechte vorbehalten|all rights reserved
reserved | 20 | 0.6 | vorbehalten | alle rechte vorbehalten
reserved | 20 | 0.6 | réservés | tous droits réservés
reserved | 20 | 0.6 | reservados | todos los derechos reservados
no-warranty | 10 | 0.3 | warranty | without warranty of any kind
no-warranty | 10 | 0.3 | warranties | without warranties or conditions of any kind
copyright | 5 | 0.2 | copyright | copyright (?:c )?(?:19|20)\d\d
see-license | 5 | 0.2 | license | see (?:the )?license (?:file )?for (?:more )?details
proprietary | 45 | 0.7 | proprietary | proprietary and confidential
proprietary | 45 | 0.7 | proprietary | proprietary licen[cs]e
proprietary | 40 | 0.6 | prohibited | unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:of this file )?(?:via any medium )?is strictly prohibited
proprietary | 40 | 0.6 | permission | no part of this (?:publication|work|book) may be reproduced
proprietary | 40 | 0.6 | written | without (?:the )?(?:prior )?(?:express )?written permission of
non-commercial | 40 | 0.6 | commercial | (?:for )?non commercial use only
non-commercial | 40 | 0.6 | noncommercial | (?:for )?noncommercial use only
research-only | 40 | 0.6 | research | (?:for )?research (?:use|purposes) only
"""

#: Short form, long form and keywords of the attribution licences; each is one rule a version.
_ATTRIBUTION = [
    ("by", "attribution"),
    ("by sa", "attribution share ?alike"),
    ("by nc", "attribution non ?commercial"),
    ("by nd", "attribution no ?deriv(?:ative)?s?"),
    ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
]
_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: Identifiers that a machine-readable tag can name.
_TAGGED = (
    "mit apache-2.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.1 lgpl-2.1-only "
    "lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later bsd-2-clause "
    "bsd-3-clause bsd-4-clause 0bsd isc mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cddl-1.1 cc0-1.0 unlicense zlib bsl-1.0 "
    "artistic-2.0 ofl-1.1 python-2.0 postgresql ncsa wtfpl eupl-1.2 afl-3.0 osl-3.0 ms-pl upl-1.0"
)


def _rules() -> list[Rule]:
    rules = []
    for line in _SIGNATURES.strip().splitlines():
        label, priority, relevance, keyword, pattern = (x.strip() for x in line.split(" | ", 4))
        rules.append(Rule(label, int(priority), float(relevance), keyword, pattern))
    for short, long in _ATTRIBUTION:
        name = "cc-" + short.replace(" ", "-")
        for version in _VERSIONS:
            label = f"{name}-{version.replace(' ', '.')}"
            rules.append(Rule(label, 94, 1.0, "cc", f"cc {short} {version}"))
            rules.append(Rule(label, 96, 1.0, "attribution", f"creative commons {long} {version}"))
            rules.append(Rule(label, 96, 1.0, "attribution", f"{long} {version} (?:international|generic|unported)"))
            rules.append(Rule(label, 97, 1.0, "creativecommons", f"creativecommons org licenses {short} {version}"))
        rules.append(Rule(name, 60, 0.7, "cc", f"cc {short}"))
        rules.append(Rule(name, 62, 0.8, "attribution", f"creative commons {long}"))
    for name in _TAGGED.split():
        rules.append(Rule(name, 99, 1.0, "spdx", f"spdx license identifier {re.sub('[.-]', ' ', name)}"))
    return rules


RULES: tuple[Rule, ...] = tuple(_rules())


def canonical(text: bytes | None) -> tuple[bytes, list[bytes]]:
    """(words joined by one space with one at either end, the words) of a UTF-8 text."""
    words = (text or b"").translate(_FOLD).split()
    return b" " + b" ".join(words) + b" ", words


class Scanner:
    """Compiled rules and base phrases."""

    def __init__(self, rules: Sequence[Rule] = RULES, base: dict[str, str] = BASE) -> None:
        self.rules = [(r, re.compile(b"(?<= )(?:" + r.pattern.encode() + b")(?= )")) for r in rules]
        self.by_keyword: dict[bytes, list[int]] = {}
        for i, r in enumerate(rules):
            self.by_keyword.setdefault(r.keyword.encode(), []).append(i)
        self.keywords = frozenset(self.by_keyword)
        self.base = [(b" " + p.encode() + b" ", label) for p, label in base.items()]
        self.base_words = frozenset(p.split()[-1].encode() for p in base)

    def base_places(self, text: bytes) -> list[tuple[int, str]]:
        """(byte offset of the first word, label) of every place of a base phrase."""
        found = []
        for phrase, label in self.base:
            at = text.find(phrase)
            while at >= 0:
                found.append((at + 1, label))
                at = text.find(phrase, at + 1)
        return sorted(found)

    def detections(self, text: bytes, present: Iterable[bytes]) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) of what is left when contained intervals of no higher priority go.

        Stronger rules are placed first: by priority, then length, then place, then label.
        """
        hits = []
        for i in sorted({i for k in present for i in self.by_keyword[k]}):
            rule, pattern = self.rules[i]
            hits += [(m.start(), m.end(), rule) for m in pattern.finditer(text)]
        hits.sort(key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].label))
        kept: list[tuple[int, int, Rule]] = []
        covers = _Intervals()
        for s, e, rule in hits:
            if not covers.contains(s, e):
                covers.add(s, e)
                kept.append((s, e, rule))
        return sorted(kept, key=lambda h: h[:2])


class _Intervals:
    """Intervals none of which contains another, so that starts and ends ascend together."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def contains(self, s: int, e: int) -> bool:
        from bisect import bisect_right

        i = bisect_right(self.starts, s) - 1
        return i >= 0 and self.ends[i] >= e

    def add(self, s: int, e: int) -> None:
        from bisect import bisect_left

        i = bisect_left(self.starts, s)
        j = i
        while j < len(self.starts) and self.ends[j] <= e:
            j += 1
        self.starts[i:j] = [s]
        self.ends[i:j] = [e]


_RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<label:string,start_word:long,end_word:long,relevance:double>>"
)
_ARROW = pa.list_(
    pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("relevance", pa.float64())])
)


def scan_licenses(docs: DataFrame, rules: Sequence[Rule] = RULES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per row of ``docs``: word and base-phrase counts, labels, score and detections.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest
    word index one starts at (null without any), base_labels and labels are distinct, sorted and
    comma-joined; labels holds the rules' as well. score is 1 less the product of the kept
    detections' doubts, over distinct labels: 0 without detections. ``detections`` are word spans,
    end exclusive. Null, empty and blank texts have no words and score 0. Rows are judged one by
    one, so order, copies and other columns do not matter; whole texts are read.
    """

    def run(batches):
        scanner = Scanner(rules, base)
        for batch in batches:
            out: dict[str, list] = {name.split()[0]: [] for name in _RESULT.split(", ")[:8]} | {"detections": []}
            for t in batch.column("text").to_pylist():
                text, words = canonical(t)
                present = scanner.keywords.intersection(words)
                places = scanner.base_places(text) if words and not scanner.base_words.isdisjoint(words) else []
                kept = scanner.detections(text, present) if present else []
                starts = sorted({p for p, _ in places} | {x for s, e, _ in kept for x in (s, e + 1)})
                index, at, count = {}, 0, 0
                for p in starts:
                    count += text.count(b" ", at, p)
                    index[p], at = count - 1, p
                labels = sorted({label for _, label in places})
                doubt = 1.0
                for relevance in {r.label: r.relevance for _, _, r in sorted(kept, key=lambda h: h[2].relevance)}.values():
                    doubt *= 1 - relevance
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(index[places[0][0]] if places else None)
                out["last_word"].append(index[places[-1][0]] if places else None)
                out["base_labels"].append(",".join(labels))
                out["labels"].append(",".join(sorted({*labels, *(r.label for _, _, r in kept)})))
                out["score"].append(1 - doubt if kept else 0.0)
                out["detections"].append(
                    [{"label": r.label, "start_word": index[s], "end_word": index[e + 1], "relevance": r.relevance} for s, e, r in kept]
                )
            del out["doc_id"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [pa.array(out[k], pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
                + [pa.array(out[k], pa.string()) for k in ("base_labels", "labels")]
                + [pa.array(out["score"], pa.float64()), pa.array(out["detections"], _ARROW)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, _RESULT)
