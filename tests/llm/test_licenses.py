import textwrap

import pytest

from unitloom.llm.licenses import RULES, SENTENCES, scan

MIT = """(1) Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
# THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_sequences_are_matched_in_order(spark):
    rows = [
        (1, "Some text here.\nLicensed under the Apache License, Version 2.0."),
        (2, "Released under the MIT License.Released under the MIT License.\nReleased under the MIT License.\nReleased under the MIT License."),
        (3, MIT),
        (4, "All rights reserved. This work is licensed under the GNU General Public License, version 3.\r\nLicensed under CC BY-NC 4.0"),
        (5, "The MIT License is nice"),
        (6, None), (7, ""), (8, " \n\t.;\n"), (None, "Licensed under CC BY 4.0."), (1, "x" * 50_000 + ". " + "Licensed under the MIT License. " * 300),
        (9, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nOther words.\nThis software is provided by someone else"),
        (10, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")
    got = {(r.doc_id, r.n_sentences): (r.sentence_ids, r.licenses, r.unmatched) for r in scan(df).collect()}
    assert got[(1, 2)] == (["apache2ref"], ["Apache-2.0"], [])
    assert got[(2, 3)] == (["mitref", "mitref"], ["MIT"], [])
    assert got[(3, 3)] == (["mitgrant", "mitnotice", "asismit"], ["MIT"], [])
    assert got[(4, 3)] == (["allrights", "gpl3ref", "ccbync4ref"], ["CC-BY-NC-4.0", "GPL-3.0-only"], ["allrights"])
    assert got[(5, 1)] == ([], [], [])
    assert all(got[(i, 0)] == ([], [], []) for i in (6, 7, 8))
    assert got[(None, 1)] == (["ccby4ref"], ["CC-BY-4.0"], [])
    assert got[(1, 301)] == (["mitref"] * 300, ["MIT"], [])
    assert got[(9, 3)] == (["bsduse"], [], ["bsduse"])
    assert got[(10, 2)] == (["apache2grant", "apache2may"], ["Apache-2.0"], [])


def test_no_python_and_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert scan(df).collect() == []
    plan = scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# The published texts, by paragraph.
MIT_GRANT = [
    "MIT License", "Copyright (c) 2020 Some One",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES.',
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "    http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL2 = [
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    HOPE, "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
]
GPL3 = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    HOPE, "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
]
PUBLISHED = {
    "MIT": (MIT_GRANT, "mitgrant mitnotice asismit liabilitymit"),
    "BSD-2-Clause": (BSD[:3] + BSD[4:], "bsduse bsdsource bsdbinary asisbsd"),
    "BSD-3-Clause": (BSD, "bsduse bsdsource bsdbinary bsdname asisbsd"),
    "Apache-2.0": (APACHE, "apache2grant apache2may apache2obtain apache2url apache2limit apache2see"),
    "GPL-2.0-or-later": (GPL2, "gplfree0 gplterms gpl2later gplhope gplimplied gpldetails gplcopy"),
    "GPL-3.0-or-later": (GPL3, "gplfree0 gplfree gplhope gplimplied gpldetails gplcopy"),
}


def layouts(paragraphs):
    """The text unwrapped, wrapped, in capitals, lettered, with two kinds of comment marks, and between other text."""
    wrap = lambda width, head="": "\n\n".join(textwrap.fill(p, width, initial_indent=" " * (len(p) - len(p.lstrip())), break_long_words=False, break_on_hyphens=False) for p in paragraphs).replace("\n", "\n" + head)
    lettered = [p if not p[:2] in ("1.", "2.", "3.") else f"({'abc'[int(p[0]) - 1]})" + p[2:] for p in paragraphs]
    yield "\n\n".join(paragraphs)
    yield from (wrap(w) for w in (40, 78, 100))
    yield wrap(72).upper()
    yield "\n\n".join(lettered)
    yield "# " + wrap(70, "# ")
    yield "/*\n * " + wrap(70, " * ").replace("\n", "\r\n") + "\n */\nint main() {}"
    yield "Some words before\n\n" + wrap(78) + "\n\nand after."


@pytest.mark.parametrize("name", sorted(PUBLISHED))
def test_published_texts_in_any_layout(spark, name):
    paragraphs, ids = PUBLISHED[name]
    texts = list(layouts(paragraphs))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan(df).collect():
        assert (r.licenses, r.sentence_ids, r.unmatched) == ([name], ids.split(), []), texts[r.doc_id]


def test_every_rule_matches_the_sentences_it_names(spark):
    """Each rule on a text of its own sentences, as the splitter makes them."""
    text_of = {n: t for n, t in SENTENCES}
    df = spark.createDataFrame([(i, "; ".join(text_of[s] for s in seq.split())) for i, (_, seq) in enumerate(RULES)], "doc_id long, text string")
    for r in scan(df).collect():
        name, seq = RULES[r.doc_id]
        assert r.sentence_ids == seq.split() and name in r.licenses and r.unmatched == []
    assert {s for _, seq in RULES for s in seq.split()} <= set(text_of)


def test_lines_that_are_no_sentence_stand_alone(spark):
    rows = [(1, "a title\nReleased under the MIT License\nAnother line"), (2, "Licensed under CC BY 4.0\nAll rights reserved\nby someone")]
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, ["MIT"]), 2: (2, ["CC-BY-4.0"])}
