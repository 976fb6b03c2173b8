"""Complete licence texts: the files in ``licenses``, as Debian ships them in /usr/share/common-licenses, and their layouts."""

from __future__ import annotations

import re
from pathlib import Path

#: SPDX identifier of each file.
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
#: What follows this line is an appendix on how to apply the licence.
END = "END OF TERMS AND CONDITIONS"


def joined(text: str) -> str:
    """Each paragraph on one line."""
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text))


def layouts(text: str) -> list[str]:
    """The text in its lines and with each paragraph on one line, with and without its appendix. A line of copyright goes where it
    is canonical, so what shares a line with it depends on the layout."""
    kinds = [text]
    if END in text:
        kinds.append(text[: text.index(END) + len(END)])
    return [form for kind in kinds for form in (kind, joined(kind))]


def texts() -> list[tuple[str, str]]:
    folder = Path(__file__).parent / "licenses"
    return [(name, form) for file, name in FILES.items() for form in layouts((folder / f"{file}.txt").read_text(encoding="utf-8"))]
