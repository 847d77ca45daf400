"""Licence recognition by sentence rules, in DataFrame functions only.

Texts are cut into sentences; normalised sentences that are in a fixed table become identifiers,
others break the sequence. Ordered rules then match runs of identifiers; what a rule has matched is
taken out before the next rule looks.
"""

from pyspark.sql import Column, DataFrame, functions as F

# Identifiers of licence sentences and their normalised texts (lower-case words).
SENTENCES = [
    ("apache2ref", "licensed under the apache license version 2 0"),
    ("apache2grant", "licensed under the apache license version 2 0 the license"),
    ("apache2may", "you may not use this file except in compliance with the license"),
    ("apache2copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache2copy", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("apache2obtain", "you may obtain a copy of the license at"),
    ("apache2url", "http www apache org licenses license 2 0"),
    ("apache2url", "https www apache org licenses license 2 0"),
    ("apache2limit", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mitref", "released under the mit license"),
    ("mitref", "licensed under the mit license"),
    ("mitgrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mitnotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("asismit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("liabilitymit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("gpl3ref", "this work is licensed under the gnu general public license version 3"),
    ("gpl3ref", "licensed under the gnu general public license version 3"),
    ("gplfree0", "this program is free software"),
    ("gplfree", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2free", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gplterms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl3later", "either version 3 of the license or at your option any later version"),
    ("gpl2later", "either version 2 of the license or at your option any later version"),
    ("gplhope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gplimplied", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpldetails", "see the gnu general public license for more details"),
    ("gplcopy", "you should have received a copy of the gnu general public license along with this program"),
    ("ccbync4ref", "licensed under cc by nc 4 0"),
    ("ccby4ref", "licensed under cc by 4 0"),
    ("ccbysa4ref", "licensed under cc by sa 4 0"),
    ("ccby4long", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsduse", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsdsource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsdbinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsdname", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("asisbsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("mplref", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("allrights", "all rights reserved"),
]

# Licences and the identifier sequences that name them; earlier rules look first.
RULES = [
    ("Apache-2.0", "apache2grant apache2may apache2obtain apache2url apache2limit apache2see"),
    ("Apache-2.0", "apache2grant apache2may apache2copy apache2limit apache2see"),
    ("Apache-2.0", "apache2grant apache2may apache2obtain apache2url"),
    ("Apache-2.0", "apache2grant apache2may apache2copy"),
    ("Apache-2.0", "apache2grant apache2may"),
    ("MIT", "mitgrant mitnotice asismit liabilitymit"),
    ("MIT", "mitgrant mitnotice asismit"),
    ("BSD-3-Clause", "bsduse bsdsource bsdbinary bsdname asisbsd"),
    ("BSD-2-Clause", "bsduse bsdsource bsdbinary asisbsd"),
    ("GPL-3.0-or-later", "gplfree0 gplfree gplhope gplimplied gpldetails gplcopy"),
    ("GPL-3.0-or-later", "gplfree0 gplfree gplhope gplimplied gpldetails"),
    ("GPL-3.0-or-later", "gplfree0 gplfree"),
    ("GPL-3.0-or-later", "gplfree0 gplterms gpl3later gplhope gplimplied gpldetails gplcopy"),
    ("GPL-3.0-or-later", "gplfree0 gplterms gpl3later"),
    ("GPL-2.0-or-later", "gplfree0 gpl2free gplhope gplimplied gpldetails gplcopy"),
    ("GPL-2.0-or-later", "gplfree0 gpl2free"),
    ("GPL-2.0-or-later", "gplfree0 gplterms gpl2later gplhope gplimplied gpldetails gplcopy"),
    ("GPL-2.0-or-later", "gplfree0 gplterms gpl2later gplhope gplimplied gpldetails"),
    ("GPL-2.0-or-later", "gplfree0 gplterms gpl2later"),
    ("Apache-2.0", "apache2ref"),
    ("MIT", "mitref"),
    ("GPL-3.0-only", "gpl3ref"),
    ("CC-BY-NC-4.0", "ccbync4ref"),
    ("CC-BY-SA-4.0", "ccbysa4ref"),
    ("CC-BY-4.0", "ccby4ref"),
    ("CC-BY-4.0", "ccby4long"),
    ("MPL-2.0", "mplref"),
]

# Comment marks and list marks ("1." or "(a)") at line starts.
COMMENT = r"(?:^|\r?\n)[ \t]*[#*/%-]*[ \t]*"
MARKS = r"(^|\n)(?:\(?(?:[0-9]{1,2}|[a-zA-Z])[.)][ \t]+)+"
# A sentence ends after . ! ? : before a blank, at a semicolon or at a blank line.
SENTENCE_END = r"[.!?:]+[ \t\r\n]+|;[ \t]*|\n[ \t\r\n]*\n"
# In a sentence that is not known, lines stand alone but for those that go on in lower case.
WRAPPED = r"([^.!?:; \t\r\n])[ \t]*\r?\n[ \t]*([a-z(])"
LINE_END = r"[ \t]*[\r\n]+[ \t]*"
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: Column) -> Column:
    """ASCII words in lower case with single blanks."""
    return F.trim(F.regexp_replace(F.translate(sentence, CAPITALS, SMALLS), "[^a-z0-9]+", " "))


def sentences(text: Column, known: Column) -> Column:
    """Normalised sentences; one that the map `known` does not hold is cut at line ends too."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), COMMENT, "\n"), MARKS, "$1")
    lines = lambda s: F.transform(F.split(F.regexp_replace(s, WRAPPED, "$1 $2"), LINE_END), normalised)
    whole = F.transform(F.split(plain, SENTENCE_END), lambda s: F.when(known[normalised(s)].isNotNull(), F.array(normalised(s))).otherwise(lines(s)))
    return F.filter(F.flatten(whole), lambda s: s != "")


def pattern(sequence: str) -> str:
    return "".join(f",{name}," for name in sequence.split())


def scan(docs: DataFrame, table=SENTENCES, rules=RULES) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, unmatched) for every row of `docs` (doc_id, text).

    sentence_ids are the known identifiers in order; licenses the licences of the rules that match,
    sorted, each once; unmatched the known sentences that no rule has used, in order. A sentence that
    is not known parts the sequences beside it. Lines of a paragraph are joined, whatever their case,
    where that gives a known sentence; comment marks and list marks at line starts do not count. Null, empty and blank texts have no sentences.
    Repeated rows and ids each give a row; further columns play no part; an empty table gives no
    rows. Texts are whole: nothing is cut off.
    """
    known = F.create_map(*[F.lit(x) for text, name in {t: n for n, t in table}.items() for x in (text, name)])
    found = docs.select("doc_id", sentences(F.col("text"), known).alias("_parts"))
    found = found.withColumn("_ids", F.transform("_parts", lambda s: F.coalesce(known[s], F.lit("|"))))
    sequence = F.array_join(F.transform("_ids", lambda s: F.concat(F.lit(","), s, F.lit(","))), "")
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern(seq)).alias("seq")) for name, seq in rules])
    state = lambda rest, names: F.struct(rest.alias("rest"), names.alias("names"))
    match = F.aggregate(
        ordered, state(sequence, F.array().cast("array<string>")),
        lambda s, r: F.when(F.instr(s["rest"], r["seq"]) > 0, state(F.replace(s["rest"], r["seq"], F.lit(",|,")), F.array_append(s["names"], r["name"]))).otherwise(s),
    )
    found = found.withColumn("_match", match)
    real = lambda c: F.filter(c, lambda s: (s != "|") & (s != ""))
    return found.select(
        "doc_id", F.size("_parts").alias("n_sentences"), real(F.col("_ids")).alias("sentence_ids"),
        F.array_sort(F.array_distinct("_match.names")).alias("licenses"), real(F.split("_match.rest", ",")).alias("unmatched"),
    )


def scan_sql(table=SENTENCES, rules=RULES) -> str:
    """The same scan as one SQL statement over `documents`, with lists as joined text."""
    names = ", ".join(f"'{t}': '{n}'" for n, t in table)
    steps, last = [], "m0"
    for i, (name, seq) in enumerate(rules):
        p = pattern(seq)
        steps.append(
            f"m{i + 1} AS (SELECT doc_id, parts, ids, replace(rest, '{p}', ',|,') AS rest, "
            f"CASE WHEN contains(rest, '{p}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})"
        )
        last = f"m{i + 1}"
    norm = lambda x: f"trim(regexp_replace(translate({x}, '{CAPITALS}', '{SMALLS}'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH p AS (
  SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '{COMMENT}', chr(10), 'g'), '{MARKS}', '\\1', 'g'), '{SENTENCE_END}') AS raw
  FROM documents
), c AS (
  SELECT doc_id, list_filter(flatten(list_transform(raw, lambda s: CASE WHEN MAP {{{names}}}[{norm('s')}] IS NOT NULL THEN [{norm('s')}]
    ELSE list_transform(string_split_regex(regexp_replace(s, '{WRAPPED}', '\\1 \\2', 'g'), '{LINE_END}'), lambda x: {norm('x')}) END)), lambda s: s <> '') AS parts
  FROM p
), k AS (SELECT doc_id, parts, list_transform(parts, lambda s: coalesce(MAP {{{names}}}[s], '|')) AS ids FROM c),
m0 AS (SELECT *, array_to_string(list_transform(ids, lambda s: ',' || s || ','), '') AS rest, []::VARCHAR[] AS names FROM k),
{", ".join(steps)}
SELECT doc_id, CAST(len(parts) AS INTEGER) AS n_sentences, array_to_string(list_filter(ids, lambda s: s <> '|'), ',') AS sentence_ids,
  array_to_string(list_sort(list_distinct(names)), ',') AS licenses,
  array_to_string(list_filter(string_split(rest, ','), lambda s: s <> '|' AND s <> ''), ',') AS unmatched
FROM {last}
"""
