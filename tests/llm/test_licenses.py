"""Licence notices in the forms they come in: wrapped, commented, and with abbreviations."""

import duckdb

from quillspark.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:"""
BSD3 = (
    BSD
    + """
# 3. Neither the name of the copyright holder nor the names of its
#    contributors may be used to endorse or promote products derived from it."""
)
APACHE = """/* Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance
 * with the License.
 * You may obtain a copy of the
 * License at http://www.apache.org/licenses/LICENSE-2.0 */"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
WRAPPED = MPL.replace("Mozilla Public ", "Mozilla Public\r\n// ")
TEXTS = [MIT, BSD, BSD3, APACHE, MPL, WRAPPED, "It is relicensed under the MIT licenses."]


def test_notices_as_they_stand(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].licenses for i in range(len(TEXTS))] == ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "MPL-2.0", ""]
    assert got[0].sentence_ids == "MITGRANT,MITNOTICE,ASIS" and got[3].sentence_ids == "APACHE2,APACHEUSE,APACHECOPY"
    assert all(r.n_unclaimed == 0 for r in got.values())


FULL_MIT = """Copyright (c) 2019 Jane Roe

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
FULL_BSD3 = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are met:
//  1. Redistributions of source code must retain the above copyright notice,
//     this list of conditions and the following disclaimer.
//  2. Redistributions in binary form must reproduce the above copyright notice,
//     this list of conditions and the following disclaimer in the documentation
//     and/or other materials provided with the distribution.
//  3. Neither the name of Example Labs, Inc. nor the names of its contributors
//     may be used to endorse or promote products derived from this software.
// THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
// ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
// WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
// IN NO EVENT SHALL EXAMPLE LABS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
// SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
// PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
// BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
// CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
// ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
FULL_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
FULL_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU %s
Public License as published by the Free Software Foundation, either version %s of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the licence for more details.
You should have received a copy of the GNU %s Public License along with this program."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""


def test_whole_licences_and_their_sql(spark):
    texts = {
        1: FULL_MIT, 2: FULL_MIT.replace("\n", " "), 3: FULL_BSD3, 4: FULL_APACHE, 5: FULL_GPL % ("General", "2", "General"), 6: FULL_GPL % ("Lesser General", "2.1", "Lesser General"),
        7: FULL_GPL % ("Affero General", "3", "Affero General"), 8: ISC, 9: FULL_MIT + "\n" + FULL_APACHE, 10: FULL_BSD3.replace("Example Labs, Inc.", "w " * 40), 11: None, 12: "",
    }
    texts |= {20 + i: t for i, t in enumerate(TEXTS)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    want = {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "Apache-2.0", 5: "GPL-2.0-or-later", 6: "LGPL-2.1-or-later", 7: "AGPL-3.0-or-later", 8: "ISC", 9: "MIT,Apache-2.0", 10: "BSD-2-Clause"}
    assert {i: got[i].licenses for i in want} == want
    assert all(got[i].n_unclaimed == 0 for i in want) and got[1].n_known == 6 and got[3].n_known == 7
    assert "BSDENDORSE" not in got[10].sentence_ids  # a name longer than the slack is not taken for one
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(texts.items()))
    cols = licenses.scan(df).columns
    assert sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({licenses.oracle()})").fetchall()) == sorted(tuple(r) for r in got.values())


def test_sentences_of_the_caller(spark):
    df = spark.createDataFrame([(1, "Use it freely. Enjoy."), (2, "Given by Jane and\n# Joe to all"), (3, "given by to all")], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df, {"FREE": "use it freely", "GIFT": "given by * to all"}, [("Free", ("FREE",)), ("Gift", ("GIFT",))]).collect()}
    assert got == {1: "Free", 2: "Gift", 3: ""}
    assert {r.n_known for r in licenses.scan(df, {}, []).collect()} == {0}


def test_cues_cover_every_sentence():
    own = licenses.cues(licenses.SENTENCES.values())
    assert all(set(own) & set(s.split()) for s in licenses.SENTENCES.values())


def test_bsd_texts_with_other_endorsement_clauses_are_not_bsd_2(spark):
    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer.\n"
    names = '3. The name "X" must not be used to endorse or promote products derived from this software without prior written permission.\n4. Products derived from this software may not be called "X".\n'
    df = spark.createDataFrame([(1, head + names), (2, head), (3, head + "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n" + names)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert got == {1: "LicenseRef-BSD-Named", 2: "BSD-2-Clause", 3: "LicenseRef-BSD-Named"}
