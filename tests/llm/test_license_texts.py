"""Licence files as they are normally laid out."""

import os
import textwrap

import pytest

from fileguard.llm.license_scan import NOTICES, license_scan
from tests.llm.cases import rows

ISC = """ISC License

Copyright (c) 2020, A. Holder

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""

BSD = """BSD 3-Clause License

Copyright (c) 2020, A. Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

HEADER = """# Copyright 2020 A. Holder
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return rows(license_scan(df), "doc_id", "license_id", "line_licenses")


def test_files_and_headers(spark):
    body = next(t for i, t in NOTICES if i == "MIT" and len(t) > 500)
    mit = "MIT License\n\nCopyright (c) 2020 A. Holder\n\n" + textwrap.fill(body, 78)
    assert found(spark, mit, ISC, BSD, BSD.replace("All rights reserved.\n", ""), HEADER, HEADER + "x = 1\n") == [
        (0, "MIT", ""), (1, "ISC", ""), (2, "BSD-3-Clause", "Proprietary"), (3, "BSD-3-Clause", ""),
        (4, "Apache-2.0", "Apache-2.0"), (5, None, "Apache-2.0"),
    ]


FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence files here")
def test_long_texts(spark):
    texts = [open(f"/usr/share/common-licenses/{name}", encoding="utf-8").read() for name in FILES]
    assert [r[1] for r in found(spark, *texts)] == list(FILES.values())


def apache():
    from pathlib import Path

    import fileguard.llm

    return (Path(fileguard.llm.__path__[0]) / "licenses" / "Apache-2.0.txt").read_text(encoding="utf-8")


def test_layouts_of_one_licence(spark):
    whole = apache()
    body = next(t for i, t in NOTICES if i == "MIT" and len(t) > 500)
    mit = lambda holder: f"MIT License\n\n{holder}\n\n{textwrap.fill(body, 60)}"
    paragraphs = "\n\n".join(" ".join(p.split()) for p in whole.split("\n\n"))
    filled = whole.replace("[yyyy]", "2024").replace("[name of copyright owner]", "Some People")
    bare = whole[: whole.index("END OF TERMS AND CONDITIONS") + len("END OF TERMS AND CONDITIONS")]
    texts = [
        whole, paragraphs, filled, bare, paragraphs[: paragraphs.index("APPENDIX:")],
        mit("Copyright Foo Authors"), mit("Copyright (c) 2019 Foo, Inc.\nAll rights reserved."), mit("© Foo"), mit("Copyright 2019 Foo. All Rights Reserved."),
    ]
    assert [r[1] for r in found(spark, *texts)] == ["Apache-2.0"] * 5 + ["MIT"] * 4


def test_clauses_marked_c_are_part_of_the_text(spark):
    texts = ["first line\n(c) you may sell it\nlast line", "first line\n(c) you may never sell it\nlast line", "first line\n(c) 2020 You\nlast line", "first line\nlast line"]
    digests = [r[0] for r in sorted(license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("digest", "doc_id").collect(), key=lambda r: r["doc_id"])]
    assert len(set(digests)) == 3 and digests[2] == digests[3]
    # Wrapped notices keep their words.
    for line in ("copyright notice and this permission notice", "COPYRIGHT HOLDERS AND CONTRIBUTORS", "Copyright License", "copyright law of the land"):
        pair = spark.createDataFrame([(0, f"a\n{line}\nb"), (1, "a\nb")], "doc_id long, text string")
        assert len({r["digest"] for r in license_scan(pair).collect()}) == 2
