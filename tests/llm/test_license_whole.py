"""Licence notices as they are written: every known sentence and every rule."""

import duckdb
import pytest

from mercato.llm import license_scan

# One sample or more of each identifier's text, as written.
SAMPLES = {
    "spdx-tag": ["SPDX-License-Identifier=Apache-2.0"],
    "copyright-line": ["Copyright (c) 2020 A Body", "(c) Copyright 2020", "Copyright A Body"],
    "rights-reserved": ["All rights reserved."],
    "mit-name": ["Released under the MIT License.", "It is available under the terms of the MIT licence"],
    "mit-permission": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies."],
    "mit-no-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.'],
    "mit-no-liability": ["In no event shall the authors or copyright holders be liable for any claim."],
    "isc-permission": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc-no-warranty": ['The software is provided "as is" and the author disclaims all warranties.'],
    "bsd-name": ["Distributed under the new BSD license."],
    "bsd-permission": ["Redistribution and use in source and binary forms, with or without modification, are permitted."],
    "bsd-source": ["Redistributions of source code must retain the notice.", "1) Redistributions of source code must retain the notice."],
    "bsd-binary": ["Redistributions in binary form must reproduce the notice."],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the line."],
    "bsd-endorsement": ["Neither the name of A nor B may be used to endorse or promote products."],
    "bsd-no-warranty": ['This software is provided by A "as is" and any express or implied warranties of any sort are disclaimed.'],
    "bsd-no-liability": ["In no event shall A be liable for any direct, indirect, incidental damages."],
    "apache-2-name": ["Licensed under the Apache License, Version 2.0 (the License)."],
    "apache-2-compliance": ["You may not use this file except in compliance with the License."],
    "apache-2-copy": ["You may obtain a copy of the License at x."],
    "apache-2-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is as is."],
    "gpl-2-name": ["Licensed under the GNU General Public License, version 2."],
    "gpl-3-name": ["Licensed under the GNU General Public License version 3.0."],
    "gpl-or-later": ["You can redistribute it and/or modify it under the terms of the GNU General Public License as published, either version 2 or later."],
    "gpl-3-or-later": ["You can redistribute it and/or modify it under the terms of the GNU General Public License as published, either version 3 or later."],
    "lgpl-2.1-name": ["Under the terms of the GNU Lesser General Public License version 2.1.",
                      "It is free under the GNU Lesser General Public License as published by the Foundation, version 2.1 or later."],
    "lgpl-3-name": ["Under the GNU Lesser General Public License, version 3."],
    "lgpl-name": ["It is under the GNU Lesser General Public License."],
    "agpl-3-name": ["Under the terms of the GNU Affero General Public License, version 3."],
    "agpl-name": ["It is under the GNU Affero General Public License."],
    "gpl-no-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."],
    "gpl-copy": ["You should have received a copy of the GNU General Public License."],
    "mpl-2-name": ["Subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, you can obtain one."],
    "epl-2-name": ["Under the terms of the Eclipse Public License v. 2.0."],
    "cc0-name": ["Dedicated to all by CC0 1.0.", "Licensed under Creative Commons Zero."],
    "cc-by-4-name": ["Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4-name": ["Licensed under CC BY-SA 4.0."],
    "cc-by-name": ["Licensed under CC BY 3.0."],
    "cc-by-sa-name": ["Licensed under CC BY-SA 2.0."],
    "cc-by-nc-name": ["Licensed under CC BY-NC 4.0."],
    "cc-by-nd-name": ["Licensed under CC BY-ND 4.0."],
    "unlicense-domain": ["This is free and unencumbered software released into the public  domain."],
    "zlib-no-warranty": ["This software is provided as-is, without any express or implied warranty."],
    "zlib-permission": ["Permission is granted to anyone to use this software for any purpose."],
    "boost-name": ["Under the Boost Software License, Version 1.0."],
    "gpl-2-head": ["GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991"],
    "gpl-3-head": ["                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"],
    "lgpl-2.1-head": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"],
    "lgpl-3-head": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"],
    "agpl-3-head": ["GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"],
    "mpl-2-head": ["Mozilla Public License Version 2.0\n=================================="],
    "apache-2-head": ["Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"],
}


def _scan(spark, texts):
    rows = license_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r for r in rows}


def test_every_sentence_is_reached(spark):
    assert set(SAMPLES) == set(license_scan.SENTENCES)
    texts = [(i, t) for i, samples in SAMPLES.items() for t in samples]
    got = _scan(spark, [t for _, t in texts])
    assert {t: got[n].sequence for n, (_, t) in enumerate(texts)} == {t: i for i, t in texts}


def test_every_rule_is_reached(spark):
    got = _scan(spark, ["\n\n".join(SAMPLES[i][0] for i in run) for _, run in license_scan.RULES])
    for n, (name, run) in enumerate(license_scan.RULES):
        assert got[n].sequence.split(",") == list(run)
        assert got[n].licenses == name and got[n].unmatched == ""


MIT = """MIT License

Copyright (c) 2020 A Body, Inc.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright (c) 2020, A Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
%s

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS)."""
SOURCE = """Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
BINARY = """Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ADVERT = """All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by A Body, Inc. and its contributors."""
NAMES = """Neither the name of A Body, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Copyright 2020 A Body
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation%s either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = {
    "MIT": [MIT], "MPL-2.0": [MPL], "Apache-2.0": [APACHE], "GPL-2.0-or-later": [GPL % (";", ";", 2)],
    "GPL-3.0-or-later": [GPL % (":", ", ", 3)],
    "BSD-2-Clause": [BSD % f"\n1. {SOURCE}\n2. {BINARY}", BSD % f"* {SOURCE}\n* {BINARY}", BSD % f"- {SOURCE}\n\n- {BINARY}"],
    "BSD-3-Clause": [BSD % f"\n1. {SOURCE}\n2. {BINARY}\n3. {NAMES}", BSD % f"* {SOURCE}\n\n* {BINARY}\n\n* {NAMES}"],
    "BSD-4-Clause": [BSD % f"1. {SOURCE}\n2. {BINARY}\n3. {ADVERT}\n4. {NAMES}"],
}


def _commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


@pytest.mark.parametrize("wrap", ["plain", "crlf", "#", "//", " *", "/* */"])
def test_wrapped_notices(spark, wrap):
    cases = [(name, t) for name, texts in NOTICES.items() for t in texts]
    shape = {"plain": lambda t: t, "crlf": lambda t: t.replace("\n", "\r\n"),
             "/* */": lambda t: "/* " + t.replace("\n", "\n   ") + " */\nint main;"}
    got = _scan(spark, [shape.get(wrap, lambda t: _commented(t, wrap))(t) for _, t in cases])
    assert [(got[n].licenses, t) for n, (_, t) in enumerate(cases)] == cases


def test_lines_beside_other_text(spark):
    """What a line said alone is still found between lines that do not end."""
    texts = {"Zlib": "a\nThis software is provided as-is, without any express or implied warranty.\nPermission is granted to anyone to use this software for any purpose", "CC-BY": "a\nb: Licensed under CC BY 3.0\nc",
             "MIT": "Copyright 2020 A Body\nThis is available under the MIT license\nSPDX-License-Identifier: MIT\nint main;",
             "Apache-2.0,MIT": "Licensed under the Apache License, Version 2.0\nReleased under the MIT License\n"}
    got = _scan(spark, list(texts.values()))
    assert [got[n].licenses for n in range(len(texts))] == list(texts)


def test_tags_state_their_licence(spark):
    texts = {"MIT": "// SPDX-License-Identifier: MIT\nint main;", "GPL-2.0-only WITH Classpath-exception-2.0": "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0",
             "MIT OR Apache-2.0": "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", "X11": "spdx-license-identifier = X11.\nx",
             "MIT,BSD-2-Clause": "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: BSD-2-Clause\nSPDX-License-Identifier: MIT", "": "SPDX-License-Identifier: ???"}
    got = _scan(spark, list(texts.values()))
    assert [got[n].licenses for n in range(len(texts))] == list(texts)
    assert all(got[n].unmatched == "" for n in range(len(texts)))


def test_twin_on_notices(spark):
    """The SQL twin reads every notice, wrap and sample as the operator does."""
    texts = [t for samples in SAMPLES.values() for t in samples] + [t for texts in NOTICES.values() for t in texts]
    texts += [_commented(t, m) for texts_ in NOTICES.values() for t in texts_ for m in ("#", "//", " *")]
    texts += ["\n\n".join(t[0] for t in SAMPLES.values()), "\n".join(t[0] for t in SAMPLES.values()), "", None, "a: \n\nCopyright x\nb", "a:\n\n\nb v. 2 co. or inc. x",
              "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0-only OR X11.\nAll rights reserved", "SPDX-License-Identifier: ???"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    names = ("n_sentences", "sequence", "licenses", "unmatched")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, {', '.join(names)} FROM ({license_scan.oracle()})").fetchall()}
    got = _scan(spark, texts)
    assert {texts[n]: tuple(r[c] for c in names) for n, r in got.items()} == {texts[n]: r for n, r in want.items()}
