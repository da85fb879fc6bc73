"""License scans by ordered signature rules, as one projection of DataFrame functions.

A text becomes words. A cheap test for a few substrings rules most texts out. In the others the words that begin a
rule's search, its keyword, are looked up in one hash table; only there, and only for the keyword's own rules, are
regexes tried, on the words around it. A detection is an interval of words with a rule's priority. One whose interval
lies in that of a stronger one is suppressed: of a lower priority number, or of the same and longer, or of the same
length and an earlier rule. What may suppress a detection has its keyword at most AROUND words away, so detections are
held against those of so many neighbouring keywords at most: work grows with the text, and nothing is shuffled.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
#: Words on either side of a keyword that a rule may cover.
AROUND = 32
#: Phrases that always count, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Texts are searched that hold one of these, or "cc by": the words of a notice, without which a name such as "Apache 2.0" is none.
GATES = ("licen", "gpl", "spdx", "copyright", "copyleft", "creative", "redistribution", "reserved", "warranty", "permission", "domain", "wtfpl")

#: License families: label, versions, long names, short names. In names, > stands before the keyword.
FAMILIES = r"""
gpl | 1.0 2.0 3.0 | (?:gnu )?>general public licen[cs]e | >gpl
lgpl | 2.0 2.1 3.0 | (?:gnu )?(?:lesser|library) >general public licen[cs]e | >lgpl
agpl | 1.0 3.0 | (?:gnu )?>affero general public licen[cs]e | >agpl
gfdl | 1.1 1.2 1.3 | (?:gnu )?free >documentation licen[cs]e | >gfdl
apache | 1.0 1.1 2.0 | >apache(?: software)? licen[cs]e | >apache
mpl | 1.0 1.1 2.0 | >mozilla public licen[cs]e | >mpl
epl | 1.0 2.0 | >eclipse public licen[cs]e | >epl
edl | 1.0 | >eclipse distribution licen[cs]e | >edl
cpl | 1.0 | >common public licen[cs]e | >cpl
cpal | 1.0 | common public >attribution licen[cs]e | >cpal
cddl | 1.0 1.1 | common >development and distribution licen[cs]e | >cddl
artistic | 1.0 2.0 | >artistic licen[cs]e | >artistic
eupl | 1.0 1.1 1.2 | >european union public licen[cs]e | >eupl
osl | 1.0 1.1 2.0 2.1 3.0 | open >software licen[cs]e | >osl
afl | 1.1 1.2 2.0 2.1 3.0 | >academic free licen[cs]e | >afl
bsl | 1.0 | >boost software licen[cs]e | >bsl
busl | 1.1 | >business source licen[cs]e | >busl
sspl | 1 | server >side public licen[cs]e | >sspl
elastic | 1.0 2.0 | >elastic licen[cs]e | >elastic
ofl | 1.0 1.1 | (?:sil )?open >font licen[cs]e | >ofl
php | 3.0 3.01 | >php licen[cs]e | >php
psf | 2.0 | >python software foundation licen[cs]e | >psf
zpl | 1.1 2.0 2.1 | >zope public licen[cs]e | >zpl
ecl | 1.0 2.0 | >educational community licen[cs]e | >ecl
lppl | 1.0 1.1 1.2 1.3c | latex >project public licen[cs]e | >lppl
apsl | 1.0 1.1 1.2 2.0 | apple public >source licen[cs]e | >apsl
cecill | 1.0 1.1 2.0 2.1 | >cecill free software licen[cs]e | >cecill
upl | 1.0 | >universal permissive licen[cs]e | >upl
qpl | 1.0 | >q public licen[cs]e | >qpl
spl | 1.0 | >sun public licen[cs]e | >spl
ms-pl | 1.0 | >microsoft public licen[cs]e | ms >pl
ms-rl | 1.0 | >microsoft reciprocal licen[cs]e | ms >rl
mulan | 1.0 2.0 | >mulan (?:psl|permissive software licen[cs]e) | >mulanpsl
cern-ohl | 1.1 1.2 2.0 | >cern open hardware licen[cs]e | cern >ohl
cdla-permissive | 1.0 2.0 | community data licen[cs]e agreement >permissive | cdla >permissive
cdla-sharing | 1.0 | community data licen[cs]e agreement >sharing | cdla >sharing
odbl | 1.0 | open (?:data commons open )?>database licen[cs]e | >odbl
odc-by | 1.0 | open data commons >attribution licen[cs]e | >odc by
ogl-uk | 1.0 2.0 3.0 | open >government licen[cs]e | >ogl(?: uk)?
etalab | 2.0 | >etalab open licen[cs]e | >etalab
openrail | 1 | >openrail(?: m)? licen[cs]e | >openrail(?: m)?
nposl | 3.0 | non profit open >software licen[cs]e | >nposl
rpl | 1.1 1.5 | >reciprocal public licen[cs]e | >rpl
""".strip()

#: Families that are also given for one version only, or for it and later ones.
GNU = ("gpl", "lgpl", "agpl", "gfdl")
#: Creative Commons: label, words of the long name after the keyword, words of the short one.
COMMONS = r"""
cc-by | attribution | by
cc-by-sa | attribution share ?alike | by sa
cc-by-nc | attribution non ?commercial | by nc
cc-by-nd | attribution no ?deriv(?:ative)?s?(?: works)? | by nd
cc-by-nc-sa | attribution non ?commercial share ?alike | by nc sa
cc-by-nc-nd | attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? | by nc nd
""".strip()
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Licenses without versions, and texts of notices: label, priority, score in hundredths, words.
SINGLE = r"""
mit | 2 | 95 | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?>mit licen[cs]e
mit | 4 | 85 | >mit licen[cs]e
mit | 4 | 85 | >expat licen[cs]e
mit-0 | 3 | 90 | >mit (?:no attribution|0)(?: licen[cs]e)
x11 | 4 | 80 | >x11 licen[cs]e
mit | 1 | 99 | permission is hereby granted free of charge to any person >obtaining a copy of this software and associated documentation files
mit | 5 | 60 | the above copyright notice and this permission notice shall be >included in all(?: copies or substantial portions of the software)?
isc | 4 | 85 | >isc licen[cs]e
isc | 1 | 97 | permission to use copy modify and (?:or )?distribute this software for any >purpose with or without fee is hereby granted
bsd-2-clause | 3 | 90 | (?:2|two) clause >bsd(?: licen[cs]e)?
bsd-2-clause | 3 | 90 | >bsd (?:2|two) clause(?: licen[cs]e)?
bsd-2-clause | 3 | 90 | (?:simplified|freebsd) >bsd licen[cs]e
bsd-3-clause | 3 | 90 | (?:3|three) clause >bsd(?: licen[cs]e)?
bsd-3-clause | 3 | 90 | >bsd (?:3|three) clause(?: licen[cs]e)?
bsd-3-clause | 3 | 90 | (?:new|modified|revised) >bsd licen[cs]e
bsd-4-clause | 3 | 90 | (?:4|four) clause >bsd(?: licen[cs]e)?
bsd-4-clause | 3 | 90 | >bsd (?:4|four) clause(?: licen[cs]e)?
bsd-4-clause | 3 | 90 | (?:original|old) >bsd licen[cs]e
0bsd | 3 | 90 | (?:zero|0) clause >bsd(?: licen[cs]e)?
0bsd | 3 | 90 | >0bsd licen[cs]e
bsd | 4 | 75 | >bsd(?: style)? licen[cs]e
bsd | 1 | 95 | >redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 1 | 96 | neither the name of (?:\S+ ){1,8}nor the names of (?:its|the) contributors may be used to >endorse or promote products
bsd-4-clause | 1 | 96 | all advertising materials mentioning features or use of this software must display the following >acknowledgement
unlicense | 3 | 90 | the >unlicense
unlicense | 1 | 98 | this is free and >unencumbered software released into the public domain
wtfpl | 3 | 90 | >wtfpl
wtfpl | 1 | 98 | do what the (?:fuck|f) you >want to public licen[cs]e
zlib | 4 | 85 | >zlib (?:libpng )?licen[cs]e
zlib | 1 | 93 | this software is provided as is without any express or implied warranty in no event will the authors be >held liable
libpng | 4 | 85 | >libpng licen[cs]e
ncsa | 3 | 90 | (?:university of illinois )?>ncsa open source licen[cs]e
postgresql | 4 | 85 | >postgresql licen[cs]e
openssl | 4 | 85 | >openssl licen[cs]e
ruby | 4 | 80 | >ruby licen[cs]e
vim | 4 | 80 | >vim licen[cs]e
curl | 4 | 80 | >curl licen[cs]e
json | 4 | 80 | >json licen[cs]e
icu | 4 | 80 | >icu licen[cs]e
ijg | 4 | 80 | independent >jpeg group licen[cs]e
w3c | 4 | 85 | >w3c software (?:notice and )?licen[cs]e
tcl | 4 | 80 | >tcl tk licen[cs]e
naist | 4 | 80 | >naist licen[cs]e
beerware | 3 | 85 | >beerware licen[cs]e
beerware | 3 | 85 | beer >ware licen[cs]e
fair | 4 | 80 | the >fair licen[cs]e
hpnd | 3 | 85 | historical >permission notice and disclaimer licen[cs]e
intel | 4 | 80 | >intel open source licen[cs]e
nokia | 4 | 80 | >nokia open source licen[cs]e
ibm-pl | 4 | 80 | >ibm public licen[cs]e
lucent-pl | 4 | 80 | >lucent public licen[cs]e
ricoh-pl | 4 | 80 | >ricoh source code public licen[cs]e
sleepycat | 4 | 80 | >sleepycat licen[cs]e
watcom | 4 | 80 | >sybase open watcom public licen[cs]e
motosoto | 4 | 80 | >motosoto licen[cs]e
netscape-pl | 4 | 80 | >netscape public licen[cs]e
vovida | 4 | 80 | >vovida software licen[cs]e
wxwindows | 4 | 80 | >wxwindows library licen[cs]e
xnet | 4 | 80 | >x net licen[cs]e
entessa | 4 | 80 | >entessa public licen[cs]e
frameworx | 4 | 80 | >frameworx (?:open )?licen[cs]e
eiffel | 4 | 80 | >eiffel forum licen[cs]e
catosl | 4 | 80 | computer associates >trusted open source licen[cs]e
cua-opl | 4 | 80 | >cua office public licen[cs]e
nasa | 4 | 80 | >nasa open source agreement licen[cs]e
oclc | 4 | 80 | >oclc research public licen[cs]e
simple-pl | 4 | 80 | >simple public licen[cs]e
sissl | 4 | 80 | sun industry >standards source licen[cs]e
openldap | 4 | 80 | >openldap public licen[cs]e
jasper | 4 | 80 | >jasper licen[cs]e
info-zip | 4 | 80 | info >zip licen[cs]e
unicode | 4 | 85 | >unicode(?: data files and software)? licen[cs]e
blue-oak | 3 | 85 | >blue oak model licen[cs]e
commons-clause | 3 | 85 | >commons clause licen[cs]e
polyform-noncommercial | 3 | 88 | >polyform noncommercial licen[cs]e
polyform-small-business | 3 | 88 | >polyform small business licen[cs]e
polyform-shield | 3 | 88 | >polyform shield licen[cs]e
hippocratic | 4 | 80 | >hippocratic licen[cs]e
parity | 4 | 75 | >parity public licen[cs]e
prosperity | 4 | 80 | >prosperity public licen[cs]e
confluent | 4 | 80 | >confluent community licen[cs]e
redis-sal | 4 | 80 | >redis source available licen[cs]e
timescale | 4 | 80 | >timescale licen[cs]e
llama | 4 | 85 | >llama (?:\d+ )*community licen[cs]e
gemma | 4 | 80 | >gemma terms of use licen[cs]e
cc0 | 2 | 95 | creative commons >zero(?: v?1 0)?(?: universal)?(?: licen[cs]e)?
cc0 | 3 | 92 | >cc0(?: v?1 0)?(?: universal)?(?: licen[cs]e)?
cc0 | 2 | 97 | creativecommons org publicdomain >zero 1 0
cc-pdm | 2 | 95 | creative commons public domain >mark(?: 1 0)?
cc-sampling | 3 | 85 | creative commons >sampling(?: plus)?
creative-commons | 5 | 60 | creative >commons(?: public)?(?: licen[cs]e)?
public-domain | 5 | 65 | (?:released|dedicated|placed|donated) (?:in|in to|into|to) the public >domain
public-domain | 6 | 50 | public >domain
gpl | 1 | 96 | this program is free software you can redistribute it and or modify it under the terms of the gnu >general public licen[cs]e
lgpl | 1 | 96 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) >general public licen[cs]e
agpl | 1 | 96 | free software you can redistribute it and or modify it under the terms of the gnu >affero general public licen[cs]e
apache-2.0 | 1 | 98 | licensed under the >apache licen[cs]e version 2 0
apache-2.0 | 2 | 90 | unless required by applicable law or agreed to in writing software >distributed under the licen[cs]e is distributed on an as is basis
apache-2.0 | 2 | 95 | apache org >licenses licen[cs]e 2 0
mpl-2.0 | 1 | 98 | this source code form is subject to the terms of the >mozilla public licen[cs]e v 2 0
gpl | 5 | 60 | see the >gnu general public licen[cs]e for more details
proprietary | 5 | 70 | proprietary and >confidential all rights reserved
proprietary | 5 | 70 | unauthorized copying of this file via any >medium is strictly prohibited all rights reserved
all-rights-reserved | 6 | 50 | all >rights reserved
copyleft | 6 | 40 | >copyleft licen[cs]e
no-warranty | 7 | 30 | provided as is without >warranty of any kind
copyright | 7 | 30 | >copyright (?:c )?(?:19|20)\d\d
open-source | 7 | 30 | open >source licen[cs]e
free-software | 7 | 30 | free >software licen[cs]e
commercial | 7 | 40 | >commercial licen[cs]e
""".strip()


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    score: float
    pattern: str

    @property
    def keyword(self) -> str:
        return re.search(">([a-z0-9]+)", self.pattern)[1]


def _version(v: str) -> str:
    """Words of a version: 2.0 is also written 2."""
    whole, _, part = v.partition(".")
    return f"{whole}(?: 0)?" if part == "0" else f"{whole} {part}" if part else whole


def _families() -> list[Rule]:
    out = []
    for label, versions, long, short in (map(str.strip, x.split(" | ")) for x in _lines(FAMILIES)):
        tag = short.split("(?:")[0].replace(">", "")
        for v in versions.split():
            n, name = _version(v), label if label.endswith(f"-{v}") else f"{label}-{v}"
            later = (("-or-later", "(?: or (?:at your option )?(?:any )?(?:later|newer)(?: version)?| plus)"), ("-only", " only"))
            for more, words in (*(later if label in GNU else ()), ("", "")):
                rank = 1 if more else 2
                out.append(Rule(name + more, rank, 0.97, f"{long} (?:{tag} )?(?:as published by the free software foundation )?(?:either )?(?:version |v ?)?{n}{words}"))
                out.append(Rule(name + more, rank + 1, 0.9, f"{short} (?:licen[cs]e )?(?:version |v ?)?{n}{words}(?: licen[cs]e)?"))
            out.append(Rule(name, 0, 1.0, f">spdx licen[cs]e identifier {short.replace('>', '')} {n}(?: only| or later)?"))
            if re.fullmatch(">[a-z]+", short):
                out.append(Rule(name, 3, 0.9, f"{short}v?{n}"))
        out.append(Rule(label, 4, 0.8, long))
        out.append(Rule(label, 5, 0.7, f"{short} licen[cs]e"))
    return out


def _commons() -> list[Rule]:
    out = []
    for label, long, short in (map(str.strip, x.split(" | ")) for x in _lines(COMMONS)):
        for v in COMMONS_VERSIONS:
            n = _version(v)
            out.append(Rule(f"{label}-{v}", 2, 0.97, f">creative commons {long} (?:version |v ?)?{n}(?: international| unported| generic)?(?: licen[cs]e)?"))
            out.append(Rule(f"{label}-{v}", 3, 0.92, f">cc {short} (?:version |v ?)?{n}(?: international| unported| generic)?(?: licen[cs]e)?"))
            out.append(Rule(f"{label}-{v}", 1, 0.98, f">creativecommons org licenses {short} {n}"))
            out.append(Rule(f"{label}-{v}", 0, 1.0, f">spdx licen[cs]e identifier cc {short} {n}"))
        out.append(Rule(label, 4, 0.85, f">creative commons {long}(?: licen[cs]e)?"))
        out.append(Rule(label, 5, 0.75, f">cc {short}(?: licen[cs]e)?"))
    return out


def _lines(table: str) -> list[str]:
    return [x for x in table.split("\n") if x.strip()]


def _singles() -> list[Rule]:
    out = []
    for label, priority, score, words in (map(str.strip, x.split(" | ")) for x in _lines(SINGLE)):
        out.append(Rule(label, int(priority), int(score) / 100, words))
    names = sorted({r.label for r in out if 2 <= r.priority <= 4 and re.fullmatch("[a-z0-9-]+", r.label)})
    return out + [Rule(n, 0, 1.0, f">spdx licen[cs]e identifier {n.replace('-', ' ')}") for n in names]


def _joined(rules: list[Rule]) -> list[Rule]:
    """Rules whose keyword ends in a version written without a space, such as gplv3, get a keyword for each way to write it."""
    out = []
    for r in rules:
        if m := re.fullmatch(r">([a-z]+)v\?(\d)(\(\?: 0\)\?| \w+|)", r.pattern):
            out += [Rule(r.label, r.priority, r.score, f">{m[1]}{v}{m[2]}{m[3]}") for v in ("", "v")]
        else:
            out.append(r)
    return out


RULES: tuple[Rule, ...] = tuple(dict.fromkeys(_joined(_families() + _commons() + _singles())))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def gate(text: Column) -> Column:
    """Whether a text is searched. lower() also folds other letters, so it may let some more through."""
    return let(F.lower(text), lambda t: functools.reduce(lambda a, g: a | t.contains(g), GATES, F.lit(False)) | t.contains("cc") & t.rlike(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"))


def _base(words: Column) -> Column:
    """For each base phrase its label, number of places, and the first and last place."""

    def place(norm: Column, total: Column, phrase: str, label: str) -> Column:
        more = phrase.count(" ")
        return let(
            F.split(norm, f"(?<= ){phrase}(?= )", -1),
            lambda p: F.struct(F.lit(label).alias("label"), (F.size(p) - 1).cast("long").alias("n"), F.when(F.size(p) > 1, spaces(F.element_at(p, 1)) - 1).cast("long").alias("first"), F.when(F.size(p) > 1, total - spaces(F.element_at(p, -1)) - more - 1).cast("long").alias("last")),
        )

    norm = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return let(norm, lambda s: let(spaces(s), lambda total: F.array(*(place(s, total, *b) for b in BASE))))


def _detections(words: Column, rules: tuple[Rule, ...]) -> Column:
    """Detections that aren't suppressed: structs (label, score, start, last)."""
    table: dict[str, list] = {}
    for i, r in enumerate(rules):
        table.setdefault(r.keyword, []).append({"id": i, "rank": r.priority, "label": r.label, "score": r.score, "regex": f"(?<![^ ]){r.pattern}(?![^ ])"})
    known = F.from_json(F.lit(json.dumps(table)), "map<string,array<struct<id:int,rank:int,label:string,score:double,regex:string>>>")

    def around(h: Column) -> Column:
        p = h["p"]
        left = F.array_join(F.slice(words, F.greatest(p - AROUND, F.lit(0)) + 1, F.least(p, F.lit(AROUND))), " ")
        return F.concat(left, F.when(p > 0, " ").otherwise(""), F.lit(">"), F.array_join(F.slice(words, p + 1, F.lit(AROUND + 1)), " "))

    def found(h: Column, text: Column) -> Column:
        tried = F.transform(F.element_at(known, h["k"]), lambda r: F.struct(r.alias("r"), F.call_function("regexp_extract", text, r["regex"], F.lit(0)).alias("m")))
        start = lambda x: h["p"] - spaces(F.substring_index(x["m"], ">", 1))
        return F.transform(F.filter(tried, lambda x: x["m"] != ""), lambda x: F.struct(x["r"]["id"].alias("id"), x["r"]["rank"].alias("rank"), x["r"]["label"].alias("label"), x["r"]["score"].alias("score"), start(x).alias("start"), (start(x) + spaces(x["m"])).alias("last")))

    def stronger(e: Column, d: Column) -> Column:
        long = (e["last"] - e["start"]) - (d["last"] - d["start"])
        return (e["start"] <= d["start"]) & (e["last"] >= d["last"]) & ((e["rank"] < d["rank"]) | (e["rank"] == d["rank"]) & ((long > 0) | (long == 0) & (e["id"] < d["id"])))

    def kept(by_place: Column) -> Column:
        near = lambda i: F.flatten(F.slice(by_place, F.greatest(i - AROUND, F.lit(0)) + 1, F.lit(2 * AROUND + 1)))
        return F.flatten(F.transform(by_place, lambda ds, i: F.when(F.size(ds) == 0, ds).otherwise(let(near(i), lambda es: F.filter(ds, lambda d: ~F.exists(es, lambda e: stronger(e, d)))))))

    hits = F.filter(F.transform(words, lambda x, i: F.struct(i.alias("p"), x.alias("k"))), lambda h: h["k"].isin(*sorted(table)))
    return let(hits, lambda hs: let(F.transform(hs, lambda h: let(around(h), lambda text: found(h, text))), kept))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of docs (doc_id, text).

    One row for each row of docs. Null and empty texts have no words, empty labels, score 0 and null places; a null
    doc_id stays null; repeated rows are repeated; other columns are ignored. Texts are read whole. score: the score of
    the surest detection, at least 0.8 where a base phrase stands. detections: those that aren't suppressed, as structs
    (label, score, start, last) of words from 0, by start. A place may hold several labels if none's interval holds another's.
    """
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    lower = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.when(gate(F.col("t")), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast("array<struct<id:int,rank:int,label:string,score:double,start:int,last:int>>")
    scanned = let(words, lambda w: F.struct(_base(w).alias("base"), F.when(F.size(w) > 0, _detections(w, rules)).otherwise(empty).alias("found")))
    x = t.select("doc_id", F.regexp_count("t", F.lit(ANY)).cast("long").alias("n_words"), scanned.alias("x")).select("doc_id", "n_words", "x.*")
    base, own = F.filter("base", lambda b: b["n"] > 0), F.transform("found", lambda d: d["label"])
    names = F.transform(base, lambda b: b["label"])
    best = F.greatest(F.aggregate("found", F.lit(0.0), lambda a, d: F.greatest(a, d["score"])), F.when(F.size(base) > 0, 0.8).otherwise(0.0))
    return x.select(
        "doc_id", "n_words", F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(names, own))), ",").alias("labels"), best.alias("score"),
        F.array_sort(F.transform("found", lambda d: F.struct(d["start"], d["last"], d["label"], d["score"]))).alias("detections"),
    )


def clash(rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, Rule]]:
    """Pairs of rules with the same words but different labels; an ordered list has none."""
    return [(a, b) for a, b in itertools.combinations(rules, 2) if a.pattern == b.pattern and a.label != b.label]
