"""Operator 3 [native]: licence scans by sentence rules.

A text is normalised as a whole (lower case, every run of other characters than a-z and 0-9 becomes
one space), so line ends, comment marks and the full stop of "v. 2.0" do not part a sentence. Known
licence sentences are found in it as sequences of whole words, wherever they stand; a ``*`` in a sentence
stands for one to SLACK words (a name, an organisation). Where several fit, the leftmost and then the one
with most literal characters counts. The sequence of identifiers is matched against ordered rules; a rule
claims each occurrence of its sequence, so a later, shorter rule only sees what is left.

The DuckDB SQL states the same definition.

All of it is built-in expressions in one map-only stage. A text is searched only if it holds one of the cue
words, which are chosen from the sentences given so that every sentence holds one: none is missed.

Edge cases: null and empty texts give no sentence and no licence. Repeated rows are answered one by
one; other columns are neither read nor returned. Without sentences or rules nothing is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Words that a ``*`` of a sentence may stand for, at most.
SLACK = 12

# Normalised licence sentences and their identifiers.
SENTENCES = {
    # notices that name a licence
    "MITREL": "released under the mit license",
    "MITLIC": "licensed under the mit license",
    "APACHE2": "licensed under the apache license version 2 0",
    "APACHEUSE": "you may not use this file except in compliance with the license",
    "APACHECOPY": "you may obtain a copy of the license at",
    "APACHEASIS": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "APACHELANG": "see the license for the specific language governing permissions and limitations under the license",
    "GPL3": "this work is licensed under the gnu general public license version 3",
    "GPL2": "this work is licensed under the gnu general public license version 2",
    "GPLLATER": "or at your option any later version",
    "LGPL3": "this work is licensed under the gnu lesser general public license version 3",
    "GNUFREE": "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "LGNUFREE": "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "AGNUFREE": "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "GNUV2": "either version 2 of the license",
    "GNUV21": "either version 2 1 of the license",
    "GNUV3": "either version 3 of the license",
    "GNUHOPE": "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GNUCOPY": "you should have received a copy of the gnu * license along with",
    "MPL2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "MPLCOPY": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "EPL2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "CCBY": "licensed under cc by 4 0",
    "CCBYSA": "licensed under cc by sa 4 0",
    "CCBYNC": "licensed under cc by nc 4 0",
    "CCBYLONG": "this work is licensed under a creative commons attribution 4 0 international license",
    "CCBYSALONG": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "CCBYNCLONG": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "CC0": "this work is dedicated to the public domain under cc0 1 0",
    "CC0LONG": "has waived all copyright and related or neighboring rights to this work",
    "RESERVED": "all rights reserved",
    # sentences of the MIT licence
    "MITGRANT": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "MITDEAL": "and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MITNOTICE": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "ASIS": "the software is provided as is without warranty of any kind",
    "MITKINDS": "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MITLIABLE": "in no event shall * be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    # sentences of the BSD licences
    "BSDHEAD": "redistribution and use in source and binary forms with or without modification are permitted",
    "BSDPROVIDED": "provided that the following conditions are met",
    "BSDSOURCE": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSDBINARY": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSDENDORSE": "neither the name of * nor the names of its contributors may be used to endorse or promote products",
    "BSDNAMES": "must not be used to endorse or promote products derived from this software",
    "BSDCALLED": "products derived from this software may not be called",
    "BSDASIS": "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "BSDLIABLE": "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    # other permissive licences
    "ISCGRANT": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "ISCNOTICE": "provided that the above copyright notice and this permission notice appear in all copies",
    "ZLIBASIS": "this software is provided as is without any express or implied warranty",
    "ZLIBGRANT": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "ZLIBORIGIN": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "UNLICENSE": "this is free and unencumbered software released into the public domain",
    "UNLICENSEUSE": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "BOOST": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
}
# Licences and the sentence sequences that state them, in order of precedence.
RULES = [
    ("MIT", ("MITGRANT", "MITDEAL", "MITNOTICE", "ASIS", "MITKINDS", "MITLIABLE")),
    ("MIT", ("MITGRANT", "MITDEAL", "MITNOTICE")),
    ("MIT", ("MITGRANT", "MITNOTICE", "ASIS")),
    ("MIT", ("MITGRANT", "MITNOTICE")),
    ("Apache-2.0", ("APACHE2", "APACHEUSE", "APACHECOPY", "APACHEASIS", "APACHELANG")),
    ("Apache-2.0", ("APACHE2", "APACHEUSE", "APACHECOPY")),
    ("BSD-3-Clause", ("BSDHEAD", "BSDPROVIDED", "BSDSOURCE", "BSDBINARY", "BSDENDORSE", "BSDASIS", "BSDLIABLE")),
    ("BSD-3-Clause", ("BSDHEAD", "BSDPROVIDED", "BSDSOURCE", "BSDBINARY", "BSDENDORSE")),
    ("BSD-3-Clause", ("BSDHEAD", "BSDPROVIDED", "BSDENDORSE")),
    ("BSD-3-Clause", ("BSDHEAD", "BSDENDORSE")),
    ("LicenseRef-BSD-Named", ("BSDHEAD", "BSDPROVIDED", "BSDSOURCE", "BSDBINARY", "BSDNAMES")),
    ("LicenseRef-BSD-Named", ("BSDHEAD", "BSDPROVIDED", "BSDSOURCE", "BSDNAMES")),
    ("LicenseRef-BSD-Named", ("BSDHEAD", "BSDPROVIDED", "BSDNAMES")),
    ("LicenseRef-BSD-Named", ("BSDHEAD", "BSDNAMES")),
    ("BSD-2-Clause", ("BSDHEAD", "BSDPROVIDED", "BSDSOURCE", "BSDBINARY", "BSDASIS", "BSDLIABLE")),
    ("BSD-2-Clause", ("BSDHEAD", "BSDPROVIDED", "BSDSOURCE", "BSDBINARY")),
    ("AGPL-3.0-or-later", ("AGNUFREE", "GNUV3", "GPLLATER", "GNUHOPE", "GNUCOPY")),
    ("AGPL-3.0-or-later", ("AGNUFREE", "GNUV3", "GPLLATER")),
    ("LGPL-3.0-or-later", ("LGNUFREE", "GNUV3", "GPLLATER", "GNUHOPE", "GNUCOPY")),
    ("LGPL-3.0-or-later", ("LGNUFREE", "GNUV3", "GPLLATER")),
    ("LGPL-2.1-or-later", ("LGNUFREE", "GNUV21", "GPLLATER", "GNUHOPE", "GNUCOPY")),
    ("LGPL-2.1-or-later", ("LGNUFREE", "GNUV21", "GPLLATER")),
    ("GPL-3.0-or-later", ("GNUFREE", "GNUV3", "GPLLATER", "GNUHOPE", "GNUCOPY")),
    ("GPL-3.0-or-later", ("GNUFREE", "GNUV3", "GPLLATER")),
    ("GPL-2.0-or-later", ("GNUFREE", "GNUV2", "GPLLATER", "GNUHOPE", "GNUCOPY")),
    ("GPL-2.0-or-later", ("GNUFREE", "GNUV2", "GPLLATER")),
    ("GPL-3.0-or-later", ("GPL3", "GPLLATER")),
    ("GPL-2.0-or-later", ("GPL2", "GPLLATER")),
    ("ISC", ("ISCGRANT", "ISCNOTICE")),
    ("Zlib", ("ZLIBASIS", "ZLIBGRANT", "ZLIBORIGIN")),
    ("Unlicense", ("UNLICENSE", "UNLICENSEUSE")),
    ("MPL-2.0", ("MPL2", "MPLCOPY")),
    ("MIT", ("MITREL",)),
    ("MIT", ("MITLIC",)),
    ("Apache-2.0", ("APACHE2",)),
    ("BSD-2-Clause", ("BSDHEAD", "BSDPROVIDED")),
    ("BSD-2-Clause", ("BSDHEAD",)),
    ("GPL-3.0-only", ("GPL3",)),
    ("GPL-2.0-only", ("GPL2",)),
    ("LGPL-3.0-only", ("LGPL3",)),
    ("MPL-2.0", ("MPL2",)),
    ("EPL-2.0", ("EPL2",)),
    ("BSL-1.0", ("BOOST",)),
    ("Unlicense", ("UNLICENSE",)),
    ("CC-BY-NC-4.0", ("CCBYNC",)),
    ("CC-BY-SA-4.0", ("CCBYSA",)),
    ("CC-BY-4.0", ("CCBY",)),
    ("CC-BY-NC-4.0", ("CCBYNCLONG",)),
    ("CC-BY-SA-4.0", ("CCBYSALONG",)),
    ("CC-BY-4.0", ("CCBYLONG",)),
    ("CC0-1.0", ("CC0",)),
    ("CC0-1.0", ("CC0LONG",)),
    ("LicenseRef-All-Rights-Reserved", ("RESERVED",)),
]


def cues(sentences) -> list[str]:
    """Words of which every sentence holds one: the word that most sentences without a cue hold, until none is without."""
    left, out = [{w for w in s.split() if w != "*"} for s in sentences], []
    while left:
        known = sorted({w for s in left for w in s})
        out.append(max(known, key=lambda w: (sum(w in s for s in left) * (len(w) > 4), len(w), w)))
        left = [s for s in left if out[-1] not in s]
    return out


def _pattern(sentence: str) -> str:
    return sentence.replace(" * ", " (?:[a-z0-9]+ ){1,%d}?" % SLACK)


def _any_of(sentences: dict[str, str]) -> str:
    # longest first, as an alternation takes the first that fits
    return r"\b(" + "|".join(map(_pattern, sorted(sentences.values(), key=lambda s: (-len(s), s)))) + r")\b"


def _identify(found: Column, sentences: dict[str, str]) -> Column:
    """The identifier of a found sentence: literal ones by lookup, those with a ``*`` by their pattern."""
    plain = {k: v for k, v in sentences.items() if "*" not in v}
    out = F.element_at(F.create_map(*[F.lit(x) for k, v in plain.items() for x in (v, k)]), found) if plain else F.lit(None).cast("string")
    for k, v in sorted(sentences.items(), key=lambda kv: (-len(kv[1]), kv[1])):
        if "*" in v:
            out = F.coalesce(out, F.when(found.rlike(f"^(?:{_pattern(v)})$"), F.lit(k)))
    return out


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules=None) -> DataFrame:
    """doc_id, known sentence identifiers in order, licences in rule order, and known sentences that no rule claims."""
    sentences, rules = SENTENCES if sentences is None else sentences, RULES if rules is None else rules
    low, none = F.lower("text"), F.array().cast("array<string>")
    if sentences:
        plain = F.regexp_replace(low, "[^a-z0-9]+", " ")
        known = F.transform(F.regexp_extract_all(plain, F.lit(_any_of(sentences)), F.lit(1)), lambda s: _identify(s, sentences))
        cued = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in cues(sentences.values())])
        ids = F.when(cued, known).otherwise(none)
    else:
        ids = none
    out = docs.select("doc_id", ids.alias("ids"))
    out = out.select("doc_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    left = F.concat(F.lit(""), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    out = out.withColumn("left", left)
    found = []
    # one projection for each rule keeps the expression linear in the number of rules
    for k, (_, seq) in enumerate(rules):
        mark = "".join(f"<{i}>" for i in seq)
        out = out.select("doc_id", "ids", *found, F.contains("left", F.lit(mark)).alias(f"r{k}"), F.replace("left", F.lit(mark), F.lit("|")).alias("left"))
        found.append(f"r{k}")
    names = F.array_distinct(F.filter(F.array(F.lit(None).cast("string"), *[F.when(F.col(f"r{k}"), F.lit(name)) for k, (name, _) in enumerate(rules)]), lambda x: x.isNotNull()))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(names, ",").alias("licenses"),
        (F.length("left") - F.length(F.replace("left", F.lit("<"), F.lit("")))).cast("long").alias("n_unclaimed"),
    )


def oracle(sentences=None, rules=None) -> str:
    """The definition in DuckDB SQL."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    own = sorted(sentences.items(), key=lambda kv: (-len(kv[1]), kv[1]))
    which = " ".join(f"WHEN regexp_full_match(x, '{_pattern(v)}') THEN '{k}'" if "*" in v else f"WHEN x = '{v}' THEN '{k}'" for k, v in own)
    steps, prev = [], "s0"
    for k, (_, seq) in enumerate(rules):
        mark = "".join(f"<{i}>" for i in seq)
        steps.append(f"s{k + 1} AS (SELECT * EXCLUDE (rest), contains(rest, '{mark}') AS r{k}, replace(rest, '{mark}', '|') AS rest FROM {prev})")
        prev = f"s{k + 1}"
    names = ", ".join(f"CASE WHEN r{k} THEN '{name}' END" for k, (name, _) in enumerate(rules))
    order = list(dict.fromkeys(name for name, _ in rules))
    has = " || ".join(f"CASE WHEN list_contains(found, '{n}') THEN ',{n}' ELSE '' END" for n in order)
    return f"""
WITH pieces AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), '{_any_of(sentences)}', 1) AS p FROM documents),
known AS (SELECT doc_id, list_transform(p, lambda x: CASE {which} END) AS ids FROM pieces),
s0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '') AS rest FROM known),
{", ".join(steps)},
named AS (SELECT *, [{names}] AS found FROM {prev})
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sentence_ids, substr({has}, 2) AS licenses,
       CAST(length(rest) - length(replace(rest, '<', '')) AS BIGINT) AS n_unclaimed FROM named"""
