"""Licence scans by ordered signature rules, in DataFrame operations alone.

A text is read as its words (A-Z lower-cased, ASCII letters and digits and everything beyond ASCII), joined by single
spaces, so line breaks, bullets and punctuation do not matter. A rule is a label, a keyword, a pattern over that form, a
priority and a confidence. The keyword gates the pattern: only rules whose keyword occurs are matched, and texts
without any keyword leave after one test. All matches of the gated rules are detections with their word intervals. A
detection that lies inside one of better priority is suppressed (equal intervals included; of equal priority the longer, then the
first rule stays), so "gnu lesser general public license version 2 1" is one LGPL and no GPL detection.

Suppression is a running maximum: detections of one text in order of their start, the furthest end among better
ones so far. Detections are rows, a text with thousands costs a sort; nothing compares all pairs.

Defined results: null and empty texts have no words and no detections; repeated rows each get the labels of their text;
texts are told apart by hash and size; columns of the table other than the added ones pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from factsieve.llm.common import col

#: Tasks that the copies of a text are dealt to where they meet its labels.
SALTS = 16

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that count as base places, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    """A signature: matches of ``pattern`` in texts with ``keyword``. Lower ``priority`` is better."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


_V = r"(?: version| v)? ?"  # before a version number
_LICENSE = "licen[sc]e"

#: Identifiers as in package metadata and file headers ("SPDX-License-Identifier: MIT" reads as below).
IDENTIFIERS = (
    ("0bsd", "0bsd"), ("afl-2.1", "afl 2 1"), ("afl-3.0", "afl 3 0"), ("agpl-1.0", "agpl 1 0"), ("agpl-3.0", "agpl 3 0"), ("apache-1.0", "apache 1 0"), ("apache-1.1", "apache 1 1"),
    ("apache-2.0", "apache 2 0"), ("apsl-2.0", "apsl 2 0"), ("artistic-1.0", "artistic 1 0"), ("artistic-2.0", "artistic 2 0"), ("blueoak-1.0.0", "blueoak 1 0 0"), ("bsd-1-clause", "bsd 1 clause"),
    ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"), ("bsl-1.0", "bsl 1 0"), ("busl-1.1", "busl 1 1"), ("cc0-1.0", "cc0 1 0"),
    ("cc-by-2.0", "cc by 2 0"), ("cc-by-2.5", "cc by 2 5"), ("cc-by-3.0", "cc by 3 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-sa-2.0", "cc by sa 2 0"), ("cc-by-sa-2.5", "cc by sa 2 5"),
    ("cc-by-sa-3.0", "cc by sa 3 0"), ("cc-by-sa-4.0", "cc by sa 4 0"), ("cc-by-nc-3.0", "cc by nc 3 0"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-nd-3.0", "cc by nd 3 0"),
    ("cc-by-nd-4.0", "cc by nd 4 0"), ("cc-by-nc-sa-3.0", "cc by nc sa 3 0"), ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"), ("cc-by-nc-nd-3.0", "cc by nc nd 3 0"), ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("cddl-1.0", "cddl 1 0"), ("cddl-1.1", "cddl 1 1"), ("cecill-2.1", "cecill 2 1"), ("cecill-b", "cecill b"), ("cecill-c", "cecill c"), ("cpal-1.0", "cpal 1 0"), ("cpl-1.0", "cpl 1 0"),
    ("ecl-2.0", "ecl 2 0"), ("elastic-2.0", "elastic 2 0"), ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"), ("eupl-1.1", "eupl 1 1"), ("eupl-1.2", "eupl 1 2"), ("gfdl-1.1", "gfdl 1 1"),
    ("gfdl-1.2", "gfdl 1 2"), ("gfdl-1.3", "gfdl 1 3"), ("gpl-1.0", "gpl 1 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("hpnd", "hpnd"), ("icu", "icu"), ("ijg", "ijg"), ("isc", "isc"),
    ("jquery-mit", "jquery mit"), ("json", "json"), ("lgpl-2.0", "lgpl 2 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3.0", "lgpl 3 0"), ("libpng-2.0", "libpng 2 0"), ("lppl-1.3c", "lppl 1 3c"),
    ("mit", "mit"), ("mit-0", "mit 0"), ("mpl-1.0", "mpl 1 0"), ("mpl-1.1", "mpl 1 1"), ("mpl-2.0", "mpl 2 0"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("mulanpsl-2.0", "mulanpsl 2 0"),
    ("ncsa", "ncsa"), ("odbl-1.0", "odbl 1 0"), ("ofl-1.1", "ofl 1 1"), ("openssl", "openssl"), ("osl-2.1", "osl 2 1"), ("osl-3.0", "osl 3 0"), ("pddl-1.0", "pddl 1 0"), ("php-3.01", "php 3 01"),
    ("postgresql", "postgresql"), ("psf-2.0", "psf 2 0"), ("python-2.0", "python 2 0"), ("ruby", "ruby"), ("sleepycat", "sleepycat"), ("sspl-1.0", "sspl 1 0"), ("unicode-3.0", "unicode 3 0"),
    ("unlicense", "unlicense"), ("upl-1.0", "upl 1 0"), ("vim", "vim"), ("w3c", "w3c"), ("wtfpl", "wtfpl"), ("x11", "x11"), ("zlib", "zlib"), ("zpl-2.1", "zpl 2 1"),
)

#: Names in running text: label, keyword, pattern.
NAMES = (
    ("mit", "mit", rf"(?:the )?(?:mit|expat) {_LICENSE}"),
    ("mit", "expat", rf"expat {_LICENSE}"),
    ("x11", "x11", rf"x11 {_LICENSE}"),
    ("apache", "apache", rf"apache (?:software )?{_LICENSE}"),
    ("apache-2.0", "apache", rf"apache (?:software )?{_LICENSE}{_V}2(?: 0)?"),
    ("apache-1.1", "apache", rf"apache (?:software )?{_LICENSE}{_V}1 1"),
    ("apache-1.0", "apache", rf"apache (?:software )?{_LICENSE}{_V}1 0"),
    ("apache-2.0", "apache", r"www apache org licenses license 2 0"),
    ("asl", "asl", r"asl 2 0"),
    ("gpl", "general", rf"(?:gnu )?general public {_LICENSE}"),
    ("gpl-1.0", "general", rf"(?:gnu )?general public {_LICENSE}{_V}1(?: 0)?"),
    ("gpl-2.0", "general", rf"(?:gnu )?general public {_LICENSE}{_V}2(?: 0)?"),
    ("gpl-3.0", "general", rf"(?:gnu )?general public {_LICENSE}{_V}3(?: 0)?"),
    ("gpl-2.0-or-later", "general", rf"(?:gnu )?general public {_LICENSE}{_V}2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("gpl-3.0-or-later", "general", rf"(?:gnu )?general public {_LICENSE}{_V}3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("gpl-2.0", "gpl", r"gpl(?:v| v| version )2(?: 0)?"),
    ("gpl-3.0", "gpl", r"gpl(?:v| v| version )3(?: 0)?"),
    ("gpl", "gpl", r"gnu gpl"),
    ("lgpl", "lesser", rf"(?:gnu )?lesser general public {_LICENSE}"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public {_LICENSE}{_V}2 1"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public {_LICENSE}{_V}3(?: 0)?"),
    ("lgpl", "library", rf"(?:gnu )?library general public {_LICENSE}"),
    ("lgpl-2.0", "library", rf"(?:gnu )?library general public {_LICENSE}{_V}2(?: 0)?"),
    ("lgpl", "lgpl", r"gnu lgpl"),
    ("agpl", "affero", rf"(?:gnu )?affero general public {_LICENSE}"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public {_LICENSE}{_V}3(?: 0)?"),
    ("gfdl", "documentation", rf"(?:gnu )?free documentation {_LICENSE}"),
    ("gfdl-1.2", "documentation", rf"(?:gnu )?free documentation {_LICENSE}{_V}1 2"),
    ("gfdl-1.3", "documentation", rf"(?:gnu )?free documentation {_LICENSE}{_V}1 3"),
    ("bsd", "bsd", rf"bsd (?:style )?{_LICENSE}"),
    ("bsd-2-clause", "bsd", rf"(?:simplified|freebsd|2 clause|two clause) bsd(?: {_LICENSE})?"),
    ("bsd-3-clause", "bsd", rf"(?:new|modified|revised|3 clause|three clause) bsd(?: {_LICENSE})?"),
    ("bsd-4-clause", "bsd", rf"(?:original|old|4 clause|four clause) bsd(?: {_LICENSE})?"),
    ("isc", "isc", rf"isc {_LICENSE}"),
    ("zlib", "zlib", rf"zlib(?: libpng)? {_LICENSE}"),
    ("libpng", "libpng", rf"libpng {_LICENSE}"),
    ("boost", "boost", rf"boost software {_LICENSE}"),
    ("bsl-1.0", "boost", rf"boost software {_LICENSE}{_V}1(?: 0)?"),
    ("mpl", "mozilla", rf"mozilla public {_LICENSE}"),
    ("mpl-1.1", "mozilla", rf"mozilla public {_LICENSE}{_V}1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public {_LICENSE}{_V}2(?: 0)?"),
    ("epl", "eclipse", rf"eclipse public {_LICENSE}"),
    ("epl-1.0", "eclipse", rf"eclipse public {_LICENSE}{_V}1(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public {_LICENSE}{_V}2(?: 0)?"),
    ("edl", "eclipse", rf"eclipse distribution {_LICENSE}"),
    ("cddl", "common", rf"common development and distribution {_LICENSE}"),
    ("cpl", "common", rf"common public {_LICENSE}"),
    ("cpal", "common", rf"common public attribution {_LICENSE}"),
    ("ipl", "ibm", rf"ibm public {_LICENSE}"),
    ("eupl", "european", rf"european union public {_LICENSE}"),
    ("osl", "open", rf"open software {_LICENSE}"),
    ("afl", "academic", rf"academic free {_LICENSE}"),
    ("ecl", "educational", rf"educational community {_LICENSE}"),
    ("artistic", "artistic", rf"artistic {_LICENSE}"),
    ("artistic-2.0", "artistic", rf"artistic {_LICENSE}{_V}2(?: 0)?"),
    ("cecill", "cecill", rf"cecill(?: free software)? {_LICENSE}"),
    ("ms-pl", "microsoft", rf"microsoft public {_LICENSE}"),
    ("ms-rl", "microsoft", rf"microsoft reciprocal {_LICENSE}"),
    ("apsl", "apple", rf"apple public source {_LICENSE}"),
    ("ncsa", "illinois", rf"university of illinois (?:ncsa )?open source {_LICENSE}"),
    ("psf", "python", rf"python software foundation {_LICENSE}"),
    ("php", "php", rf"php {_LICENSE}"),
    ("ruby", "ruby", rf"ruby {_LICENSE}"),
    ("perl", "perl", r"same terms as perl(?: itself)?"),
    ("postgresql", "postgresql", rf"postgresql {_LICENSE}"),
    ("openssl", "openssl", rf"openssl {_LICENSE}"),
    ("sleepycat", "sleepycat", rf"sleepycat {_LICENSE}"),
    ("json", "json", rf"json {_LICENSE}"),
    ("w3c", "w3c", rf"w3c (?:software )?(?:notice and )?{_LICENSE}"),
    ("zpl", "zope", rf"zope public {_LICENSE}"),
    ("lppl", "latex", rf"latex project public {_LICENSE}"),
    ("ofl", "sil", rf"sil open font {_LICENSE}"),
    ("ofl-1.1", "sil", rf"sil open font {_LICENSE}{_V}1 1"),
    ("upl", "universal", rf"universal permissive {_LICENSE}"),
    ("unlicense", "unlicense", r"the unlicense"),
    ("wtfpl", "fuck", rf"do what the fuck you want to public {_LICENSE}"),
    ("mulanpsl", "mulan", rf"mulan permissive software {_LICENSE}"),
    ("odbl", "database", rf"open (?:data commons open )?database {_LICENSE}"),
    ("pddl", "public", rf"public domain dedication and {_LICENSE}"),
    ("busl", "business", rf"business source {_LICENSE}"),
    ("sspl", "server", rf"server side public {_LICENSE}"),
    ("elastic", "elastic", rf"elastic {_LICENSE}"),
    ("commons-clause", "commons", rf"commons clause(?: {_LICENSE})?(?: condition)?"),
    ("cc", "creative", rf"creative commons (?:public )?{_LICENSE}"),
    ("cc-by", "creative", rf"creative commons attribution(?: {_LICENSE})?"),
    ("cc-by-3.0", "creative", rf"creative commons attribution 3 0(?: unported)?(?: international)?(?: {_LICENSE})?"),
    ("cc-by-4.0", "creative", rf"creative commons attribution 4 0(?: international)?(?: {_LICENSE})?"),
    ("cc-by-sa", "creative", rf"creative commons attribution share ?alike(?: {_LICENSE})?"),
    ("cc-by-sa-3.0", "creative", rf"creative commons attribution share ?alike 3 0(?: unported)?(?: {_LICENSE})?"),
    ("cc-by-sa-4.0", "creative", rf"creative commons attribution share ?alike 4 0(?: international)?(?: {_LICENSE})?"),
    ("cc-by-nc", "creative", rf"creative commons attribution non ?commercial(?: [34] 0)?(?: {_LICENSE})?"),
    ("cc-by-nd", "creative", rf"creative commons attribution no ?deriv(?:ative)?s(?: [34] 0)?(?: {_LICENSE})?"),
    ("cc-by-nc-sa", "creative", rf"creative commons attribution non ?commercial share ?alike(?: [34] 0)?(?: {_LICENSE})?"),
    ("cc-by-nc-nd", "creative", rf"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [34] 0)?(?: {_LICENSE})?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", "public", r"(?:is|are|released|placed|dedicated|work) (?:in|into|to) the public domain"),
)

#: Sentences of licence texts and notices: label, keyword, pattern.
SENTENCES = (
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "noninfringement", r"without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "endorse", r"(?:may be used to|used to) endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd", "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("apache-2.0", "apache", r"licensed under the apache license version 2 0"),
    ("apache-2.0", "limitations", r"see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "copy", r"you should have received a copy of the gnu general public license along with this (?:program|software|file)"),
    ("lgpl", "copy", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|software)"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse", r"made available under the terms of the eclipse public license"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("bsl-1.0", "boost", r"distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("cc0", "waive", r"waived all copyright and related or neighboring rights"),
    ("cc-by", "creative", r"(?:this work is )?licensed under a creative commons attribution [34] 0"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "retain", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("proprietary", "reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"confidential and proprietary"),
    ("proprietary", "prohibited", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|work) .{0,60}?(?:is )?(?:strictly )?prohibited"),
    ("non-commercial", "commercial", r"for (?:personal )?non ?commercial use only"),
    ("evaluation", "evaluation", r"for evaluation purposes only"),
    ("no-redistribution", "redistribute", r"(?:you may|must|do) not redistribute"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
)


def rules() -> tuple[Rule, ...]:
    """All rules in their order: sentences of licences, identifiers, names with a version, plain names."""
    out = [Rule(label, keyword, p, 1, 1.0) for label, keyword, p in SENTENCES[:-8]]
    out += [Rule(label, "spdx", rf"spdx {_LICENSE} identifier {name}(?: (?:only|or later))?(?! \d)", 2, 1.0) for label, name in IDENTIFIERS]
    out += [Rule(label, name.split()[0], rf"{_LICENSE} {name}(?: (?:only|or later))?(?! \d)", 3, 0.8) for label, name in IDENTIFIERS if " " in name]
    out += [Rule(label, keyword, p, 3 if any(c.isdigit() for c in label) else 4, 0.9 if any(c.isdigit() for c in label) else 0.7) for label, keyword, p in NAMES]
    out += [Rule(label, keyword, p, 5, 0.4) for label, keyword, p in SENTENCES[-8:]]
    return tuple(out)


def _gate(rule: Rule) -> str:
    """A string every match of the rule has: the stem of "license" where the pattern cannot do without it, else the keyword."""
    needed, last = rule.pattern, None
    while needed != last:
        needed, last = re.sub(r"\(\?:[^()]*\)\?", "", needed), needed
    return "licen" if _LICENSE in needed or "license" in needed else rule.keyword


def normal_form(text: Column) -> Column:
    """The words joined by single spaces, with a space at either end."""
    low = F.translate(text, UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^0-9a-z\x{80}-\x{10FFFF}]+", " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def _places(form: Column, pattern: Column) -> Column:
    """Word intervals (end exclusive) of the matches, which begin and end at words.

    Matches are marked with a character no word has; the marked words give the starts in one pass.
    """
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    marked = F.split(F.trim(F.regexp_replace(form, whole, F.lit("\x01$0"))), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i.cast("long"))), lambda i: i.isNotNull())
    sizes = F.transform(F.regexp_extract_all(form, whole, F.lit(0)), lambda x: _spaces(x) + 1)
    return F.when(F.rlike(form, whole), F.zip_with(starts, sizes, lambda s, n: F.struct(s.alias("start"), (s + n).alias("end"))))


def base(form: Column) -> dict[str, Column]:
    """``n_base, first_word, last_word, base_labels`` of a normal form: the places of :data:`PHRASES`."""
    counts, firsts, lasts, labels = [], [], [], []
    words = _spaces(form) - 1
    for phrase, label in PHRASES:
        n = F.regexp_count(form, F.lit(f"(?<= ){phrase}(?= )")).cast("long")
        inner = F.lit(f" {phrase} ")
        counts.append(n)
        firsts.append(F.when(n > 0, _spaces(F.substring_index(form, f" {phrase} ", 1))))
        lasts.append(F.when(n > 0, words - _spaces(F.substring_index(form, f" {phrase} ", -1)) - _spaces(inner) + 1))
        labels.append(F.when(n > 0, F.lit(label)))
    found = F.array_sort(F.array_compact(F.array(*labels)))
    return {"n_base": sum(counts[1:], counts[0]), "first_word": F.array_min(F.array(*firsts)), "last_word": F.array_max(F.array(*lasts)), "base_labels": found}


def detections(forms: DataFrame, scan: tuple[Rule, ...]) -> DataFrame:
    """``h, size`` and the detections that no other suppresses, of ``forms(h, size, form)`` with one row for each text."""
    table = F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for k, r in enumerate(scan)])
    gated = forms.select("h", "size", "form", F.explode(F.filter(table, lambda r: F.contains(F.col("form"), r["keyword"]))).alias("r"))
    found = gated.select("h", "size", "r.nth", "r.label", "r.priority", "r.confidence", F.explode(_places(F.col("form"), F.col("r.pattern"))).alias("p"))
    rows = found.select("h", "size", "nth", "label", "priority", "confidence", "p.start", "p.end")
    text = W.Window.partitionBy("h", "size")
    upto = text.orderBy("start").rangeBetween(W.Window.unboundedPreceding, 0)
    peers = W.Window.partitionBy("h", "size", "priority").orderBy("start", F.col("end").desc(), "nth").rowsBetween(W.Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in scan})
    reach = {f"_{p}": F.max(F.when(F.col("priority") == p, F.col("end"))).over(upto) for p in levels}
    better = [(F.col("priority") > p) & F.coalesce(F.col(f"_{p}") >= F.col("end"), F.lit(False)) for p in levels]
    inside = reduce(lambda a, b: a | b, better) | F.coalesce(F.col("_peer") >= F.col("end"), F.lit(False))
    return rows.withColumns({**reach, "_peer": F.max("end").over(peers)}).where(~inside).select(*rows.columns)


def scan(documents: DataFrame, text: str = "text", signatures: tuple[Rule, ...] | None = None) -> DataFrame:
    """``documents`` with ``n_words``, the base columns, ``labels`` (base ones included) and ``score``, the best confidence."""
    signatures = rules() if signatures is None else signatures
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    names = [c for c in documents.columns if c not in added]
    own = F.coalesce(col(text), F.lit(""))
    low = F.lower("own")
    words = sorted({_gate(r) for r in signatures} | {"licen"})
    rows = documents.select(F.struct(*[col(c) for c in names]).alias("row"), own.alias("own"))
    rows = rows.withColumn("low", low).withColumn("gate", reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in words]))
    form = F.when(F.col("gate"), normal_form(F.col("own")))
    # texts without a form ask for nothing and are spread by a number; copies of the others are dealt to ``SALTS`` tasks
    number = F.monotonically_increasing_id()
    rows = rows.select("row", F.regexp_count("own", F.lit(WORD)).cast("long").alias("n_words"), "gate", F.xxhash64("own").alias("h"), F.octet_length("own").alias("size"), form.alias("form"), number.alias("number"))
    forms = rows.where(F.col("form").isNotNull()).groupBy("h", "size").agg(F.first("form").alias("form"))
    said = detections(forms, signatures).groupBy("h", "size").agg(F.array_sort(F.collect_set("label")).alias("said"), F.max("confidence").alias("score"))
    said = said.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumns({"h": F.when(F.col("gate"), F.col("h")).otherwise(F.col("number")), "size": F.when(F.col("gate"), F.col("size")).otherwise(-1), "salt": F.pmod("number", F.lit(SALTS)).cast("int")})
    with_base = rows.withColumns({"form": F.coalesce("form", F.lit("  "))}).withColumns(base(F.col("form"))).drop("form")
    joined = with_base.join(said, ["h", "size", "salt"], "left")
    none = F.expr("cast(array() as array<string>)")
    labels = F.array_sort(F.array_union(F.col("base_labels"), F.coalesce("said", none)))
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.7).otherwise(0.0))
    return joined.select(*[F.col("row")[c].alias(c) for c in names], "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
