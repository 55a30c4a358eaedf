"""Templates of the licence scan that are longer than a line, or name a version: headers, headings, SPDX names, full texts.

A passage is compared with windows of as many words, a full text with a whole record. Each has key words, all of which a
window must hold, so that no version or variant passes for another; windows are laid where the first of them stands.
"""

from __future__ import annotations

import os
import re
from typing import NamedTuple

WORD = "[a-z0-9]+"
_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")


class Passage(NamedTuple):
    name: str
    text: str
    keys: tuple[str, ...]
    whole: bool = False


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


_CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
             "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = [("GPL", "General Public License", ("1", "2", "3")), ("LGPL", "Library General Public License", ("2",)),
        ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("3",)),
        ("GFDL", "Free Documentation License", ("1.1", "1.2", "1.3"))]
_HEADINGS = [
    ("GPL-1.0", "GNU General Public License Version 1, February 1989"), ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"), ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"), ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("GFDL-1.1", "GNU Free Documentation License Version 1.1, March 2000"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"), ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-1.1", "Apache Software License, Version 1.1"),
    ("MPL-1.1", "Mozilla Public License Version 1.1 1. Definitions"), ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"), ("EPL-2.0", "Eclipse Public License - v 2.0"), ("BSL-1.0", "Boost Software License - Version 1.0"),
    ("CC0-1.0", "CC0 1.0 Universal")]
#: Key words of the full texts.
_FULL = {
    "Apache-2.0": "contributor derivative", "Artistic-1.0-Perl": "artistic package", "BSD-2-Clause": "redistributions disclaimer",
    "BSD-3-Clause": "redistributions disclaimer neither", "CC0-1.0": "affirmer waiver", "GFDL-1.2": "invariant cover document",
    "GFDL-1.3": "invariant cover document", "GPL-1.0": "gnu general public warranty", "GPL-2.0": "gnu general public warranty",
    "GPL-3.0": "gnu general public warranty", "ISC": "permission granted fee", "LGPL-2.0": "gnu library general public",
    "LGPL-2.1": "gnu lesser general public", "LGPL-3.0": "gnu lesser general public", "MIT": "permission granted charge", "MPL-1.1": "covered contributor",
    "MPL-2.0": "covered contributor"}
#: Full texts of at most so many words also stand inside other files, as passages of their first words.
_SHORT, _OPENING = 400, 120


def _spdx() -> list[tuple[str, str]]:
    ids = [(i, i) for i in ("0BSD", "AFL-3.0", "Apache-1.0", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause",
                            "BSD-4-Clause", "BSL-1.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "ISC",
                            "MIT", "MPL-1.0", "MPL-1.1", "MPL-2.0", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib")]
    ids += [(f"CC-{kind}-{v}", f"CC-{kind}-{v}") for kind in _CREATIVE for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    for short, _, versions in _GNU:
        for v in (x if "." in x else x + ".0" for x in versions):
            ids += [(f"{short}-{v}", f"{short}-{v}{end}") for end in ("", "-only", "-or-later")]
    return ids


def _notices() -> list[tuple[str, str]]:
    """Names of licences, with their version, as notices give them."""
    found = []
    for short, title, versions in _GNU:
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            found += [(name, f"GNU {title} version {x}") for x in dict.fromkeys((v, name.rsplit("-", 1)[1]))]
            found += [(name, f"GNU {short} {x}") for x in dict.fromkeys((f"version {v}", f"v{v}"))]
    for title, short, versions in [("Apache License", "Apache", ("1.0", "1.1", "2.0")), ("Mozilla Public License", "MPL", ("1.0", "1.1", "2.0")),
                                   ("Eclipse Public License", "EPL", ("1.0", "2.0")), ("Boost Software License", "BSL", ("1.0",)),
                                   ("Common Development and Distribution License", "CDDL", ("1.0", "1.1")), ("Artistic License", "Artistic", ("1.0", "2.0")),
                                   ("Academic Free License", "AFL", ("3.0",)), ("SIL Open Font License", "OFL", ("1.1",)),
                                   ("European Union Public Licence", "EUPL", ("1.1", "1.2"))]:
        found += [(f"{short}-{v}", f"{title}{kind} {v}") for v in versions for kind in (" version", " v.", "")]
    for kind, title in _CREATIVE.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            found += [(f"CC-{kind}-{v}", f"CC {kind} {v}"), (f"CC-{kind}-{v}", f"Creative Commons {title} {v}")]
    return found + [("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
                    ("Zlib", "zlib License"), ("Unlicense", "Unlicense")]


def _headers() -> list[tuple[str, str, str]]:
    found = []
    for short, title, versions in _GNU[:4]:
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            found += [(name, f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {title} {rest}", f"GNU {title} {v}")
                      for thing in ("program", "library")
                      for rest in (f"as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
                                   f"version {v} as published by the Free Software Foundation.")]
    found.append(("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                  "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Apache License 2.0"))
    found.append(("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                  "this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License 2.0"))
    found.append(("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in '
                  "compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/", "Mozilla Public License 1 contents"))
    found.append(("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                  "or distribute this software", "unencumbered public domain"))
    found.append(("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                  "http://www.boost.org/LICENSE_1_0.txt)", "Boost License 1 0"))
    return found


def passages() -> list[Passage]:
    """All of them. Notices count after a word that grants: a licence that is only mentioned gives none."""
    found = [Passage(name, f"SPDX-License-Identifier: {spdx}", tuple(words(f"SPDX License Identifier {spdx}"))) for name, spdx in _spdx()]
    for name, title in _notices():
        found += [Passage(name, f"{grant} {title}", tuple(words(title)) + tuple(words(grant)))
                  for grant in ("licensed under the", "licensed under", "released under the", "distributed under the", "under the terms of the")]
    found += [Passage(name, text, tuple(words(text))) for name, text in _HEADINGS]
    found += [Passage(name, text, tuple(words(keys))) for name, text, keys in _headers()]
    for name, keys in _FULL.items():
        with open(os.path.join(_FOLDER, f"{name}.txt"), encoding="utf-8") as file:
            text = file.read()
        found.append(Passage(name, text, tuple(keys.split()), True))
        listed = words(text)
        start = listed.index("redistribution" if name.startswith("BSD") else "permission") if len(listed) <= _SHORT else None
        if start is not None:
            found.append(Passage(name, " ".join(listed[start:start + _OPENING]), tuple(keys.split())))
    # "mit" is a common German word; no window is laid at it
    return [p._replace(keys=tuple(sorted(dict.fromkeys(p.keys), key=lambda w: w == "mit"))) for p in dict.fromkeys(found)]
