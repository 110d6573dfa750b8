"""License scans by sentence rules (operator 8).

DataFrame functions only; no Python runs on the executors. A text is cut into
sentences, sentences are normalised and looked up in a table of known licence
sentences, and the sequence of their identifiers is matched against ordered
rules, the most specific first. A rule uses up the sentences it matches. The
ids of an SPDX tag are sentences of their own. Texts that hold none of the
words of which every known sentence has one are only counted.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeweave.runtime import col_of, fresh_name

# Wordings of public licences and notices, sentence by sentence.
SENTENCES: dict[str, str] = {
    "grant_mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "notice_mit": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as_is_mit": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "grant_isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "grant_isc_and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "grant_bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "source_bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "binary_bsd": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "endorse_bsd": "Neither the name of holder may be used to endorse or promote products derived from this software without specific prior written permission",
    "advertise_bsd": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "grant_apache": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "only_apache": "you may not use this file except in compliance with the License",
    "obtain_apache": "You may obtain a copy of the License at",
    "as_is_apache": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "grant_gpl2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "grant_gpl3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "hope_gpl": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib": "This software is provided 'as-is', without any express or implied warranty",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "mpl2_word": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
    "grant_0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "grant_mit0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "grant_boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "notice_boost": "Distributed under the Boost Software License, Version 1.0",
    "epl2": "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")",
    "epl2_notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl1_notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    # sentences of whole licence texts
    "whole_gpl3": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "whole_agpl3": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    "whole_lgpl3": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    "whole_gpl2": "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License",
    "whole_lgpl2": "This License Agreement applies to any software library or other program which contains a notice placed by the copyright holder or other authorized party saying it may be distributed under the terms of this Lesser General Public License (also called \"this License\")",
    "terms_apache": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "define_apache": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document",
    "grant_mpl2": "Covered Software is provided under this License on an \"as is\" basis, without warranty of any kind, either expressed, implied, or statutory, including, without limitation, warranties that the Covered Software is free of defects, merchantable, fit for a particular purpose or non-infringing",
    "whole_epl2": "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT",
    "whole_cc0": "Certain owners wish to permanently relinquish those rights to a Work for the purpose of contributing to a commons of creative, cultural and scientific works (\"Commons\") that the public can reliably and without fear of later claims of infringement build upon, modify, incorporate in other works, reuse and redistribute as freely as possible in any form whatsoever and for any purposes, including without limitation commercial purposes",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
}

# The GNU families, the versions of each, and what their grants call the work.
GNU = {
    "GPL": ("GNU General Public License", ("1", "2", "3"), "program"),
    "LGPL": ("GNU Lesser General Public License", ("2.1", "3"), "library"),
    "LGPL-library": ("GNU Library General Public License", ("2",), "library"),
    "AGPL": ("GNU Affero General Public License", ("3",), "program"),
}
_FSF = " as published by the Free Software Foundation"
for _family, (_called, _versions, _work) in GNU.items():
    _grant = f"This {_work} is free software; you can redistribute it and/or modify it under the terms of the {_called}"
    for _v in _versions:
        for _mark in ";,":  # the version clause follows a semicolon or a comma
            SENTENCES[f"later {_family} {_v}{_mark}"] = f"{_grant}{_FSF}{_mark} either version {_v} of the License, or (at your option) any later version"
            SENTENCES[f"only {_family} {_v}{_mark}"] = f"{_grant}{_FSF}{_mark} version {_v} of the License"
        SENTENCES[f"only {_family} {_v}"] = f"{_grant} version {_v}{_FSF}"
    SENTENCES[f"grant {_family}"] = _grant + _FSF
#: Normalised openings that name the program; texts put another name there, so no rule asks for them.
OPENINGS = frozenset({"this program is free software", "this library is free software"})

# Title lines of licence texts, some of two lines.
TITLES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("GPL-3.0", ("GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007")),
    ("GPL-2.0", ("GNU GENERAL PUBLIC LICENSE", "Version 2, June 1991")),
    ("GPL-1.0", ("GNU GENERAL PUBLIC LICENSE", "Version 1, February 1989")),
    ("LGPL-3.0", ("GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007")),
    ("LGPL-2.1", ("GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999")),
    ("LGPL-2.0", ("GNU LIBRARY GENERAL PUBLIC LICENSE", "Version 2, June 1991")),
    ("AGPL-3.0", ("GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007")),
    ("GFDL-1.3", ("GNU Free Documentation License", "Version 1.3, 3 November 2008")),
    ("Apache-2.0", ("Apache License", "Version 2.0, January 2004")),
    ("MPL-2.0", ("Mozilla Public License Version 2.0",)),
    ("EPL-2.0", ("Eclipse Public License - v 2.0",)),
    ("EPL-1.0", ("Eclipse Public License - v 1.0",)),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003",)),
    ("MIT", ("The MIT License (MIT)",)),
    ("MIT", ("The MIT License",)),
    ("MIT", ("MIT License",)),
    ("ISC", ("ISC License",)),
    ("BSD-2-Clause", ("BSD 2-Clause License",)),
    ("BSD-3-Clause", ("BSD 3-Clause License",)),
    ("Unlicense", ("The Unlicense",)),
    ("CC0-1.0", ("CC0 1.0 Universal",)),
    *((f"CC-{k}-4.0", (f"{name} 4.0 International{tail}",)) for k, name in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ) for tail in ("", " Public License")),
)

# Names under which texts declare a licence in one line.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("the MIT License", "MIT License", "the MIT license (MIT)", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache-2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License version 2", "the GNU GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License version 3", "the GNU GPL v3", "GPLv3", "GPL-3.0"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPL-3.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License", "BSD-3-Clause"),
    "ISC": ("the ISC License", "ISC"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC-BY-NC-ND-4.0"),
    "CC0-1.0": ("CC0", "CC0 1.0", "the CC0 1.0 Universal License", "CC0-1.0"),
    "EPL-1.0": ("the Eclipse Public License 1.0", "the Eclipse Public License, version 1.0", "EPL-1.0"),
    "EPL-2.0": ("the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0", "EPL-2.0"),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "BSL-1.0"),
    "WTFPL": ("the WTFPL", "WTFPL"),
    "Artistic-2.0": ("the Artistic License 2.0", "Artistic-2.0"),
    "Unlicense": ("the Unlicense", "Unlicense"),
    "Zlib": ("the zlib License", "Zlib"),
}
for _v in "23":
    _whole = (f"the GNU General Public License, version {_v}", f"the GNU GPL v{_v}", f"the GNU GPLv{_v}", f"the GPL, version {_v}", f"the GPL v{_v}", f"GPL v{_v}", f"GPLv{_v}")
    NAMES[f"GPL-{_v}.0"] = tuple(dict.fromkeys((*NAMES[f"GPL-{_v}.0"], *_whole)))
    NAMES[f"GPL-{_v}.0-or-later"] = tuple(f"{c} {end}" for c in _whole for end in ("or later", "or any later version", "or (at your option) any later version")) + (f"GPL-{_v}.0-or-later",)
for _k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    NAMES[f"CC-{_k}-3.0"] = (f"CC {_k} 3.0", f"CC-{_k}-3.0")
# Openings of a one-line declaration.
SUBJECTS = ("", "This work is ", "This file is ", "This project is ", "This software is ", "This program is ", "This code is ", "This document is ", "It is ", "The code is ", "All content is ", "Use of this source code is ")
VERBS = ("licensed under ", "released under ", "distributed under ", "published under ", "available under ", "made available under ")
# Ids of SPDX tags besides those of NAMES; the GNU families take endings.
SPDX = (
    "MIT-0 Apache-1.1 BSD-1-Clause BSD-4-Clause 0BSD X11 NCSA OpenSSL PostgreSQL PSF-2.0 Ruby Vim HPND JSON curl libpng-2.0 MPL-1.1 CDDL-1.0 CDDL-1.1 Artistic-1.0 "
    "EUPL-1.1 EUPL-1.2 OFL-1.1 MS-PL MS-RL LPPL-1.3c AFL-3.0 UPL-1.0 BlueOak-1.0.0 Unicode-DFS-2016 W3C CC-BY-3.0 CC-BY-SA-3.0 CC-BY-NC-3.0 CC-PDDC CECILL-2.1"
).split()
SPDX_GNU = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-1.0", "AGPL-3.0", "GFDL-1.1", "GFDL-1.2", "GFDL-1.3")

def _gnu_rules() -> list[tuple[str, tuple[str, ...]]]:
    out = []
    for family, (_, versions, _) in GNU.items():
        for v in reversed(versions):
            name = f"{family.split('-')[0]}-{v if '.' in v else v + '.0'}"
            for kind, marks, called in (("later", ";,", f"{name}-or-later"), ("only", (";", ",", ""), f"{name}-only")):
                out += [(called, (f"{kind} {family} {v}{mark}", *hope)) for mark in marks for hope in (("hope_gpl",), ())]
        out.append((family.split("-")[0], (f"grant {family}",)))  # no version, or a clause that isn't known
    return out


#: Ordered rules: a licence and the wordings that must follow in this order, others may lie between; the parts of a wording follow each other at once.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("grant_mit", "notice_mit", "as_is_mit")),
    ("MIT", ("grant_mit", "notice_mit")),
    ("MIT-0", ("grant_mit0", "as_is_mit")),
    ("BSD-4-Clause", ("grant_bsd", "source_bsd", "binary_bsd", "advertise_bsd", "endorse_bsd")),
    ("BSD-3-Clause", ("grant_bsd", "source_bsd", "binary_bsd", "endorse_bsd")),
    ("BSD-2-Clause", ("grant_bsd", "source_bsd", "binary_bsd")),
    ("Apache-2.0", ("grant_apache", "only_apache", "obtain_apache", "as_is_apache")),
    ("Apache-2.0", ("grant_apache",)),
    *((name, tuple(f"title {t}" for t in lines)) for name, lines in TITLES if len(lines) > 1),
    ("Apache-2.0", ("terms_apache", "define_apache")),
    *_gnu_rules(),
    ("AGPL-3.0", ("whole_agpl3",)),
    ("LGPL-3.0", ("whole_lgpl3",)),
    ("GPL-3.0", ("whole_gpl3",)),
    ("GPL-2.0", ("whole_gpl2",)),
    ("LGPL-2.1", ("whole_lgpl2",)),
    ("Zlib", ("zlib", "zlib_grant")),
    ("ISC", ("grant_isc",)),
    ("ISC", ("grant_isc_and",)),
    ("0BSD", ("grant_0bsd",)),
    ("BSL-1.0", ("grant_boost",)),
    ("BSL-1.0", ("notice_boost",)),
    ("MPL-2.0", ("mpl2",)),
    ("MPL-2.0", ("mpl2_word",)),
    ("MPL-2.0", ("grant_mpl2",)),
    ("EPL-2.0", ("epl2", "whole_epl2")),
    ("EPL-2.0", ("epl2_notice",)),
    ("EPL-1.0", ("epl1_notice",)),
    ("CC0-1.0", ("whole_cc0",)),
    ("WTFPL", ("wtfpl",)),
    ("Unlicense", ("unlicense",)),
    *((name, tuple(f"title {t}" for t in lines)) for name, lines in TITLES if len(lines) == 1),
    *((name, (f"declared {name}",)) for name in NAMES),
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What a line of a comment or list may start with.
_LEAD = r"[ \t*#/;%>|-]*"
#: Sentences end at these marks before white space or the end, and at line ends.
LINE_END = r"[.!?;:]+(?:[ \t\r\n]+|\z)|[\r\n]+"
#: Sentences that are wrapped over lines end at the marks, at blank lines, blank lines of comments among them, at list numbers, and with a line of copyright, which goes.
WRAPPED_END = (
    r"[.!?;:]+(?:[ \t\r\n]+|\z)|(?:\A|[\r\n])" + _LEAD + r"(?:copyright[ \t]+|\(c\)[ \t]*)(?:\(c\)|©|[0-9]{4}|by )[^\r\n]*|(?:\A|[\r\n])" + _LEAD + r"all rights reserved[.]?[ \t]*"
    r"|\r?\n" + _LEAD + r"\r?\n|[\r\n]" + _LEAD + r"\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]+"
)
_GAP = "[^a-z0-9]+"
#: Names as they stand in running text, the longest first.
_NAMED = "|".join(
    sorted({re.sub("[^a-z0-9]+", lambda m: "[ .-]" if "." in m[0] else "[ \\t\\r\\n,(-]+", re.sub("^the ", "", c.lower()).rstrip(")")) for some in NAMES.values() for c in some}, key=lambda x: (-len(x), x))
)
_SEP = r"[ \t\r\n]+"
#: A declaration's grammar, reduced step by step to ``licensed under`` and one name: the terms of, dual, governed by, either of, a name before its verb, and names in lists of up to three.
_LISTED = (r"\b((?:licensed|released|distributed|published|available) under (?:the )?(?:" + _NAMED + r")\)?(?: licen[cs]e)?),? (?:and/or|and|or) (?:the )?(" + _NAMED + r")\b", "$1. licensed under $2")
DECLARED = (
    (r"\b(under|by|of)" + _SEP + "(?:the|all)" + _SEP + "terms" + _SEP + "(?:and" + _SEP + "conditions" + _SEP + ")?of" + _SEP, "$1 "),
    (r"\b(?:dual|multi|double)[ \t-]+licen[cs]ed\b", "licensed"),
    (r"\b(?:governed|covered)" + _SEP + "by" + _SEP, "licensed under "),
    (r"\bunder" + _SEP + "(?:either" + _SEP + "(?:of" + _SEP + ")?)", "under "),
    (r"\bunder" + _SEP + "a" + _SEP + "(creative)" + r"\b", "under the $1"),
    (r"\bis (" + _NAMED + r")[ -]licensed\b", "is licensed under $1"),
    _LISTED,
    _LISTED,
)
#: Before sentences are cut, in order: the holders' names of a clause that forbids endorsement go, a field named license has no colon, and the v of a version no stop. Then declarations are reduced.
BEFORE = (
    (r"(?s)neither" + _GAP + "the" + _GAP + "names?" + _GAP + "of" + r"[^a-z0-9].{1,200}?[^a-z0-9]may" + _GAP + "be" + _GAP + "used" + _GAP + "to" + _GAP + "endorse", "neither the name of holder may be used to endorse"),
    (r"(?s)the" + _GAP + "names?" + _GAP + "of" + r"[^a-z0-9][^.;:]{1,200}?[^a-z0-9]may" + _GAP + "not" + _GAP + "be" + _GAP + "used" + _GAP + "to" + _GAP + "endorse", "neither the name of holder may be used to endorse"),
    (r"(licen[cs]e)[\"']?[ \t]*[:=][ \t]*[\"']?", "$1 "),
    (r"\bv[.][ \t\r\n]+([0-9])", "v $1"),
    *DECLARED,
)
#: The expression of an SPDX tag, and what parts its ids.
SPDX_TAG = r"spdx-license-identifier[ \t]*[: ][ \t]*([a-z0-9.+() \t-]*)"
SPDX_BETWEEN = r"[ \t()]+(?:(?:or|and|with)[ \t()]+)*"
#: Parts of words of which every known sentence has one; ``known_sentences`` checks it.
TRIGGERS = ("licen", "permission", "redistribut", "copyright", "warrant", "free software", "domain", "agreement", "version", "releas", "distribut", "publish", "availab", "commons", "attribution", "cc0", "advertis")


def normalise(sentence: str) -> str:
    """ASCII letters in lower case, digits and full stops stay; all else parts words."""
    return re.sub(r"[^a-z0-9.]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip(" ")


def parts_of(wording: str) -> list[str]:
    """The normalised sentences of a licence wording, cut at its inner sentence ends as texts are."""
    wording = wording.lower()
    for pattern, put in BEFORE:
        wording = re.sub(pattern, put.replace("$", "\\"), wording)
    return [p for p in (normalise(x) for x in re.split(LINE_END.replace(r"\z", r"\Z"), wording)) if p]


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier: every part of the licence wordings, and declarations built by rule."""
    known = {}
    for ident, wording in SENTENCES.items():
        parts = parts_of(wording)
        for p in parts:
            known.setdefault(p, ident if len(parts) == 1 else f"part {p}")
    for name, called in NAMES.items():
        for c in called:
            for s in SUBJECTS:
                for v in VERBS:
                    known.setdefault(normalise(s + v + c), f"declared {name}")
            known.setdefault(normalise(f"License {c}"), f"declared {name}")
    for _, lines in TITLES:
        for t in lines:
            known.setdefault(normalise(t), f"title {t}")
    bare = [k for k in known if not any(t in k for t in TRIGGERS)]
    if bare:
        raise ValueError(f"sentences without a trigger: {bare}")
    return known


def spdx_ids() -> dict[str, str]:
    """SPDX id in lower case to the licence's name; an ending + means or later."""
    ids = {x.lower(): x for x in (*NAMES, *SPDX)}
    for g in SPDX_GNU:
        ids |= {g.lower(): g, f"{g}+".lower(): f"{g}-or-later"} | {f"{g}{end}".lower(): f"{g}{end}" for end in ("-only", "-or-later")}
    return ids


def identifiers() -> dict[str, int]:
    every = [*known_sentences().values(), *(f"spdx {name}" for name in spdx_ids().values())]
    return {ident: i + 1 for i, ident in enumerate(dict.fromkeys(every))}


def rule_patterns() -> list[tuple[int, str, str]]:
    """(licence number, pattern, replacement) of each rule over a sequence such as ``12,7,31,``."""
    number, codes, known = {n: i + 1 for i, n in enumerate(licence_names())}, identifiers(), known_sentences()
    gap = r"((?:L?\d+,)*?)"
    out = []
    for name, idents in (*RULES, *((name, (f"spdx {name}",)) for name in dict.fromkeys(spdx_ids().values()))):
        parts = [[known[p] for p in parts_of(SENTENCES[i]) if p not in OPENINGS] if i in SENTENCES else [i] for i in idents]
        pattern = r"\b" + gap.join("".join(f"{codes[p]}," for p in some) for some in parts)
        out.append((number[name], pattern, f"L{number[name]}," + "".join(f"${k + 1}" for k in range(len(idents) - 1))))
    return out


def licence_names() -> list[str]:
    return sorted({name for name, _ in RULES} | set(spdx_ids().values()))


def _sentences(low: Column, ends: str) -> Column:
    """Normalised sentences of a text in lower case, some of them empty: passes over the whole text, none over each sentence."""
    marked = F.regexp_replace(low, ends, "\x01")
    return F.split(F.btrim(F.regexp_replace(marked, "[^a-z0-9.\x01]+", " ")), " ?\x01 ?")


def _sequence(sentences: str, known: dict[str, str], ids: dict[str, int]) -> Column:
    """Identifiers of the known ones, each with a comma, as one SQL expression: its thousands of literals are parsed once, and IN looks them up by hash."""
    by_ident: dict[str, list[str]] = {}
    for sentence, ident in known.items():
        by_ident.setdefault(ident, []).append(sentence)
    listed = ",".join(f"'{s}'" for s in known)  # normalised: letters, digits, stops and spaces only
    cases = " ".join(f"WHEN x IN ({','.join(f"'{s}'" for s in some)}) THEN '{ids[ident]},'" for ident, some in by_ident.items())
    return F.expr(f"array_join(transform(filter({sentences}, x -> x IN ({listed})), x -> CASE {cases} END), '')")


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_sentences``, ``sentence_ids`` and ``licenses`` to the rows of ``docs``.

    n_sentences: sentences with a letter or digit, cut at line ends as well;
    sentence_ids: identifiers of the known ones, each followed by a comma, in
    order, once as cut at line ends and, after a bar, once as wrapped over
    lines, and after another bar those of SPDX tags; licenses: names of the
    rules that match one of the sequences, sorted, joined by commas, empty if
    none. Null and empty texts have no sentences; a text is scanned whole,
    however long. Equal rows have equal results and all stay; an empty table
    gives no rows. All columns stay; names that clash get trailing underscores.
    Nothing is shuffled, so no source or text is a hot group.
    """
    known, ids, names = known_sentences(), identifiers(), licence_names()
    text = F.coalesce(col_of(text_col).cast("string"), F.lit(""))
    out = [fresh_name(docs, x) for x in ("n_sentences", "sentence_ids", "licenses")]
    low, by_line, wrapped, tags = [fresh_name(docs, x) for x in ("low", "by_line", "wrapped", "tags")]
    none = F.array().cast("array<string>")
    count = F.size(F.filter(F.split(text, LINE_END), lambda x: x.rlike("[A-Za-z0-9]"))).cast("long")
    # lower() may turn other characters into a-z too, so the guard lets through more texts at most
    asked = reduce(lambda a, b: a | b, [F.contains(F.col(low), F.lit(t)) for t in TRIGGERS])
    guarded = docs.withColumn(low, F.lower(text)).select(*[col_of(c) for c in docs.columns], asked.alias(low))
    ready = F.translate(text, _UPPER + "\x01", _UPPER.lower() + " ")
    for pattern, put in BEFORE:
        ready = F.regexp_replace(ready, pattern, put)
    ready = guarded.select(*[col_of(c) for c in docs.columns], count.alias(out[0]), F.when(F.col(low), ready).alias(low))  # null where no known sentence can be
    found = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(SPDX_TAG), F.lit(1)), lambda x: F.split(x, SPDX_BETWEEN)))
    cut = ready.select("*", _sentences(F.col(low), LINE_END).alias(by_line), _sentences(F.col(low), WRAPPED_END).alias(wrapped), found.alias(tags))
    cut = cut.select(*[col_of(c) for c in docs.columns], F.col(out[0]), *[F.coalesce(F.col(c), none).alias(c) for c in (by_line, wrapped, tags)])
    spdx = {k: f"spdx {v}" for k, v in spdx_ids().items()}
    parts = [_sequence(by_line, known, ids), _sequence(wrapped, known, ids), _sequence(tags, spdx, ids)]
    seen = cut.select(*[col_of(c) for c in docs.columns], F.col(out[0]), F.concat_ws("|", *parts).alias(out[1]))
    rest = F.col(out[1])
    for _, pattern, put in rule_patterns():
        rest = F.regexp_replace(rest, pattern, put)
    found = F.array_distinct(F.regexp_extract_all(rest, F.lit(r"L(\d+),"), F.lit(1)))
    called = F.array(*[F.lit(n) for n in names])
    listed = F.array_join(F.array_sort(F.transform(found, lambda x: F.element_at(called, x.cast("int")))), ",")
    return seen.select("*", F.when(F.col(out[1]) == "||", F.lit("")).otherwise(listed).alias(out[2]))


def op8_sql() -> str:
    """The same scan of ``documents`` in SQL."""
    known, ids, names = known_sentences(), identifiers(), licence_names()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for pattern, put in BEFORE:
        low = f"regexp_replace({low}, {q(pattern)}, {q(put.replace('$', chr(92)))}, 'g')"
    clean = "trim(regexp_replace(x, '[^a-z0-9.]+', ' ', 'g'), ' ')"
    pairs = ", ".join(f"({q(s)}, {ids[i]})" for s, i in known.items())
    tags = ", ".join(f"({q(s)}, {ids[f'spdx {i}']})" for s, i in spdx_ids().items())
    seq = lambda ends: f"(SELECT d.row, k.n, u.i FROM d, unnest(regexp_split_to_array(d.low, {q(ends)})) WITH ORDINALITY AS u(x, i) JOIN k ON k.s = {clean})"
    rest = "coalesce(a.q, '') || '|' || coalesce(b.q, '') || '|' || coalesce(g.q, '')"
    for _, pattern, put in rule_patterns():
        rest = f"regexp_replace({rest}, {q(pattern)}, {q(re.sub(r'[$](\d)', r'\\\1', put))}, 'g')"
    called = "[" + ", ".join(q(n) for n in names) + "]"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text, {low} AS low FROM documents),
k(s, n) AS (VALUES {pairs}),
m(s, n) AS (VALUES {tags}),
a AS (SELECT row, string_agg(n || ',', '' ORDER BY i) AS q FROM {seq(LINE_END)} GROUP BY row),
b AS (SELECT row, string_agg(n || ',', '' ORDER BY i) AS q FROM {seq(WRAPPED_END)} GROUP BY row),
g AS (SELECT row, string_agg(n || ',', '' ORDER BY i, j) AS q
      FROM (SELECT row, i, unnest(t) AS x, generate_subscripts(t, 1) AS j
            FROM (SELECT row, i, regexp_split_to_array(e, {q(SPDX_BETWEEN)}) AS t FROM d, unnest(regexp_extract_all(d.low, {q(SPDX_TAG)}, 1)) WITH ORDINALITY AS u(e, i)))
      JOIN m ON m.s = x GROUP BY row),
f AS (SELECT d.doc_id, CAST(len(list_filter(regexp_split_to_array(d.text, {q(LINE_END)}), lambda x: regexp_matches(x, '[A-Za-z0-9]'))) AS BIGINT) AS n_sentences,
             coalesce(a.q, '') || '|' || coalesce(b.q, '') || '|' || coalesce(g.q, '') AS sentence_ids, {rest} AS rest
      FROM d LEFT JOIN a ON d.row = a.row LEFT JOIN b ON d.row = b.row LEFT JOIN g ON d.row = g.row)
SELECT doc_id, n_sentences, sentence_ids,
       array_to_string(list_sort(list_transform(list_distinct(regexp_extract_all(rest, 'L(\\d+),', 1)), lambda x: {called}[CAST(x AS INTEGER)])), ',') AS licenses
FROM f
"""
