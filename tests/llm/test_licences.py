from tables import awkward, docs, empty

from evwarden.llm.licences import NOTICES, licence_matches

MIT = """Copyright (c) 2020 Someone

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def found(spark, *texts):
    rows = licence_matches(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    return sorted((r.id, r.licence, r.n_sentences) for r in rows)


def test_whole_licence_and_notices(spark):
    assert found(spark, MIT, "First line\nReleased under the MIT License.\nMore. licensed under the  APACHE license, version 2.0!") == [
        (0, "MIT", 3), (1, "Apache-2.0", 1), (1, "MIT", 1)
    ]


def notice(licence, nth=0):
    return [t for n, t in NOTICES if n == licence][nth]


def test_order_gaps_and_longer_rules(spark):
    bsd = [" ".join(x.split()) for x in notice("BSD-3-Clause").split("\n\n")]
    assert found(spark, " ".join(bsd)) == [(0, "BSD-3-Clause", 4)]  # not also BSD-2-Clause
    assert found(spark, " ".join(bsd[:3])) == [(0, "BSD-2-Clause", 3)]
    assert found(spark, " ".join(reversed(bsd))) == []
    assert found(spark, " Other one. Another. ".join(bsd[:3])) == [(0, "BSD-2-Clause", 3)]
    assert found(spark, " Some. Three. More. ".join(bsd[:3])) == []
    assert found(spark, " ".join([*bsd[:2], notice("MIT"), bsd[2]])) == [(0, "MIT", 1)]
    assert found(spark, "Released under the MIT License. " * 500) == [(0, "MIT", 1)] * 500


#: Headers as their licences tell people to write them.
HEADERS = {
    "GPL-3.0-or-later": """This file is part of Foobar.

Foobar is something. This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2.0-or-later": """Copyright (C) 1999 Name of Author
This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Copyright 2014 The Authors. All Rights Reserved.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.""",
    "BSD-2-Clause": """Copyright (c) 2000, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this
       list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice,
       this list of conditions and the following disclaimer in the documentation
       and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".""",
    "ISC": """Copyright (c) 4-digit year, Company or Person's Name

Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.""",
    "MIT": MIT,
}


def test_headers_plain_indented_and_in_comments(spark):
    styles = [
        lambda t: t, lambda t: "\n".join("    " + x for x in t.split("\n")), lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")),
        lambda t: "\n".join(f"// {x}" for x in t.split("\n")), lambda t: "/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */\nint x;",
        lambda t: "import os\n\n" + t.replace("\n", "\r\n"),
    ]
    texts = [style(t) for t in HEADERS.values() for style in styles]
    got = [(i, licence) for i, licence, _ in found(spark, *texts)]
    assert got == [(i, list(HEADERS)[i // len(styles)]) for i in range(len(texts))]


def test_every_notice_is_found_as_itself(spark):
    rows = found(spark, *[t for _, t in NOTICES])
    assert [(i, n) for i, n, _ in rows] == [(i, n) for i, (n, _) in enumerate(NOTICES)]


def test_lines_without_marks(spark):
    assert found(spark, "Some words\nLicensed under CC BY 4.0\nOther words", "some licensed under CC BY 4.0 words") == [(0, "CC-BY-4.0", 1)]


def test_own_rules_and_awkward_rows(spark):
    table = docs(spark, [(1, "Use it. Keep it.", "a"), (1, "Use it. Keep it.", "a"), (None, "use it; keep it", "b"), (3, None, "c")])
    rows = licence_matches(table, notices=[("Own", "Use it.\n\nKeep it!"), ("None", " . ")]).collect()
    assert sorted((r.id or 0, r.licence, r.first_sentence, r.last_sentence) for r in rows) == [(0, "Own", 0, 1), (1, "Own", 0, 1), (1, "Own", 0, 1)]
    assert licence_matches(awkward(spark)).count() == 0 and licence_matches(empty(spark)).count() == 0


def test_very_long_texts(spark):
    texts = ["# " * 60_000, "> * // " * 20_000, "1 2 3 " * 30_000, "a\n" * 50_000, "copyright " * 20_000, "x. " * 50_000]
    assert found(spark, *[t + "\n\nReleased under the MIT license." for t in texts]) == [(i, "MIT", 1) for i in range(len(texts))]


def test_only_built_in_functions(spark):
    plan = licence_matches(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
