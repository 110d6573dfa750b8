"""License scans of texts as they are found: comments, tags, holders' names, whole licence texts. The texts are written out here, apart from the tables."""

import os

import duckdb
import pytest

from treeweave.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Copyright 2008 {0}  All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

    * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
{1}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""
ENDORSE = """    * Neither the name of {0} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
AUTHOR = "3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n"
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
AGPL = """Frob is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document."""


def commented(text, lead, first="", last=""):
    return first + "\n".join((lead + " " + x).rstrip() for x in text.split("\n")) + last


CASES = {
    "SPDX-License-Identifier: MIT": "MIT",
    "License: MIT": "MIT",
    '{"license": "MIT"}': "MIT",
    "// SPDX-License-Identifier: Apache-2.0\nint x;": "Apache-2.0",
    "# SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND BSD-3-Clause */": "BSD-3-Clause,GPL-2.0-only",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
    "spdx-license-identifier: lgpl-2.1+": "LGPL-2.1-or-later",
    "SPDX-License-Identifier: NoSuchLicense": "",
    MIT: "MIT",
    commented("Copyright (c) 2020 A Holder\n" + MIT, " *", "/*\n", "\n */"): "MIT",
    commented("Copyright (c) 2020 A Holder\n\n" + MIT, "#"): "MIT",
    commented("© 2020 A Holder\nAll rights reserved.\n" + MIT, "//"): "MIT",
    BSD.format("Google Inc.", ENDORSE.format("Google Inc.")): "BSD-3-Clause",
    BSD.format("The Regents", ENDORSE.format("the University of\nCalifornia, Berkeley")): "BSD-3-Clause",
    commented(BSD.format("Google Inc.", ENDORSE.format("Google Inc.")), "//"): "BSD-3-Clause",
    BSD.format("A Holder", AUTHOR): "BSD-3-Clause",
    BSD.format("A Holder", ""): "BSD-2-Clause",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.": "GPL-3.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n": "GPL-2.0",
    "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": "LGPL-2.1",
    "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0",
    "  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.": "GPL-3.0",
    LGPL: "LGPL-2.1-or-later",
    commented(AGPL, "#"): "AGPL-3.0-or-later",
    APACHE: "Apache-2.0",
    "Mozilla Public License Version 2.0\n==================================\n": "MPL-2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed": "MPL-2.0",
    "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED": "EPL-2.0",
    "Attribution-ShareAlike 4.0 International\n\n=======": "CC-BY-SA-4.0",
    "Creative words under no licence at all. The permission was not granted.": "",
    "Version 3, 29 June 2007": "",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "Distributed under the terms of the MIT License": "MIT",
    "Use of this source code is governed by the MIT license": "MIT",
    "This project is dual-licensed under MIT and Apache-2.0.": "Apache-2.0,MIT",
    "Licensed under either of Apache License, Version 2.0 or MIT license.": "Apache-2.0,MIT",
    "Licensed under MIT or Apache-2.0 or BSD-3-Clause": "Apache-2.0,BSD-3-Clause,MIT",
    "This work is licensed under CC BY-SA 3.0": "CC-BY-SA-3.0",
    "The code is GPL v2 licensed": "GPL-2.0",
    "This software is released under the terms and conditions of the GPL, version 3 or later.": "GPL-3.0-or-later",
    "We talked under the terms of the MIT faculty, and governed by its rules.": "",
    "Licensed under MIT or some other licence": "",
    "It was released under pressure, or later, by MIT.": "",
}


@pytest.fixture(scope="module")
def scanned(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    return licenses.scan_licenses(df).select("doc_id", "n_sentences", "sentence_ids", "licenses").collect()


def test_texts_as_found(scanned):
    got = {list(CASES)[r["doc_id"]]: r["licenses"] for r in scanned}
    assert {t: x for t, x in got.items() if x != CASES[t]} == {}


def test_sql_twin_on_texts_as_found(scanned):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(CASES)))
    assert sorted(map(tuple, scanned)) == sorted(con.execute(licenses.op8_sql()).fetchall())


def test_every_known_sentence_has_a_trigger(spark, sf):
    """The guard skips nothing: texts without a trigger hold no known sentence."""
    known = {k for k in licenses.known_sentences()}
    assert all(any(t in k for t in licenses.TRIGGERS) for k in known) and any(t in "spdx-license-identifier" for t in licenses.TRIGGERS)
    assert os.path.exists(sf)
