"""Signature rules of the licence scan, hand-written over the words of a text.

A rule is (label, priority class, keyword, pattern). Patterns see lower-case words
with one space between them: ``cc by nc 4 0`` for ``CC BY-NC 4.0``. The keyword is
a substring of the lower-cased text without which the rule is not tried. Classes:
0 notice or licence text, 1 name with version, 2 name, 3 hint.
"""

from __future__ import annotations

#: Base phrases: always the first rules; never suppressed in what the query returns.
BASE = (("cc-by", 3, "cc", "cc by"), ("gpl", 3, "general", "general public license"), ("reserved", 3, "reserved", "all rights reserved"))

_VERSION = "(?: version| v)?"

NOTICES = """
apache-2.0 | apache | licensed under the apache license version 2 0(?: the license)?
apache-2.0 | apache | you may not use this file except in compliance with the license
apache-2.0 | apache | www apache org licenses license 2 0
mit | permission | permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | licen | licensed under the mit licen[cs]e
isc | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | endorse | neither the name of(?: \\S+){1,12} may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
gpl-2.0-or-later | general | either version 2 of the license or at your option any later version
gpl-3.0-or-later | general | either version 3 of the license or at your option any later version
gpl-2.0 | general | licensed under the gnu general public licen[cs]e version 2(?: 0)?
gpl-3.0 | general | licensed under the gnu general public licen[cs]e version 3(?: 0)?
gpl | free | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | hope | this program is distributed in the hope that it will be useful but without any warranty
lgpl | lesser | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl | lesser | under the terms of the gnu lesser general public licen[cs]e
agpl | affero | under the terms of the gnu affero general public licen[cs]e
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
unlicense | domain | this is free and unencumbered software released into the public domain
boost-1.0 | boost | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | warrant | this software is provided as is without any express or implied warranty in no event will the authors be held liable
wtfpl | fuck | do what the fuck you want to public license
artistic | artistic | the intent of this document is to state the conditions under which a package may be copied
ofl | font | this font software is licensed under the sil open font license
python | python | this license agreement is between the python software foundation
warranty | warrant | the software is provided as is without warranty of any kind
warranty | warrant | without even the implied warranty of merchantability or fitness for a particular purpose
warranty | warrant | in no event shall the(?: \\S+){1,8} be liable for any
cc-legal | creative | this work is licensed under a creative commons(?: \\S+){1,8} licen[cs]e
cc-legal | creative | to view a copy of this licen[cs]e visit
cc-legal | creative | creativecommons org licenses \\S+(?: \\S+){0,3}
cc0 | domain | to the extent possible under law(?: \\S+){1,12} waived all copyright and related or neighboring rights
commercial | proprietary | proprietary and confidential
commercial | proprietary | this software is the proprietary information of
commercial | commercial | for non commercial use only
commercial | written | without(?: the)?(?: express| prior)? written permission
crown | crown | contains public sector information licensed under the open government licen[cs]e
"""

#: name | keyword | pattern of the name | versions
FAMILIES = """
apache | apache | apache(?: software)? licen[cs]e | 1.0 1.1 2.0
gpl | general | gnu general public licen[cs]e | 1.0 2.0 3.0
lgpl | general | gnu (?:lesser|library) general public licen[cs]e | 2.0 2.1 3.0
agpl | general | gnu affero general public licen[cs]e | 1.0 3.0
fdl | documentation | gnu free documentation licen[cs]e | 1.1 1.2 1.3
gpl | gpl | (?:gnu )?gpl | 1.0 2.0 3.0
lgpl | gpl | (?:gnu )?lgpl | 2.0 2.1 3.0
agpl | gpl | (?:gnu )?agpl | 1.0 3.0
mpl | mozilla | mozilla public licen[cs]e | 1.0 1.1 2.0
mpl | mpl | mpl | 1.0 1.1 2.0
epl | eclipse | eclipse public licen[cs]e | 1.0 2.0
edl | eclipse | eclipse distribution licen[cs]e | 1.0
cddl | common | common development and distribution licen[cs]e | 1.0 1.1
cddl | cddl | cddl | 1.0 1.1
cpl | common | common public licen[cs]e | 1.0
cpal | common | common public attribution licen[cs]e | 1.0
ibm-pl | ibm | ibm public licen[cs]e | 1.0
eupl | european | european union public licen[cs]e | 1.0 1.1 1.2
eupl | eupl | eupl | 1.0 1.1 1.2
artistic | artistic | artistic licen[cs]e | 1.0 2.0
afl | academic | academic free licen[cs]e | 1.1 1.2 2.0 2.1 3.0
osl | open | open software licen[cs]e | 1.0 1.1 2.0 2.1 3.0
ofl | open | (?:sil )?open font licen[cs]e | 1.0 1.1
ogl | open | open government licen[cs]e | 1.0 2.0 3.0
odbl | open | open (?:data commons open )?database licen[cs]e | 1.0
pddl | domain | public domain dedication and licen[cs]e | 1.0
odc-by | open | open data commons attribution licen[cs]e | 1.0
boost | boost | boost software licen[cs]e | 1.0
python | python | python(?: software foundation)? licen[cs]e | 2.0
php | php | php licen[cs]e | 2.0 3.0 3.01
zpl | zope | zope public licen[cs]e | 1.1 2.0 2.1
qpl | public | q public licen[cs]e | 1.0
lppl | latex | latex project public licen[cs]e | 1.0 1.1 1.2 1.3
apsl | apple | apple public source licen[cs]e | 1.0 1.1 1.2 2.0
ms-pl | microsoft | microsoft public licen[cs]e | 1.0
ms-rl | microsoft | microsoft reciprocal licen[cs]e | 1.0
npl | netscape | netscape public licen[cs]e | 1.0 1.1
spl | sun | sun public licen[cs]e | 1.0
ecl | educational | educational community licen[cs]e | 1.0 2.0
cecill | cecill | cecill(?: b| c)? | 1.0 1.1 2.0 2.1
sspl | server | server side public licen[cs]e | 1.0
bsl | business | business source licen[cs]e | 1.0 1.1
elastic | elastic | elastic licen[cs]e | 1.0 2.0
openssl | openssl | openssl licen[cs]e | 1.0 3.0
vim | vim | vim licen[cs]e | 1.0
unicode | unicode | unicode licen[cs]e(?: agreement)? | 1.0 3.0
blueoak | blue | blue oak model licen[cs]e | 1.0.0
upl | universal | universal permissive licen[cs]e | 1.0
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[cs]e | 1.0
rail | rail | (?:open)?rail m? ?licen[cs]e | 1.0
llama | llama | llama (?:2 |3 )?community licen[cs]e | 1.0
"""

#: Creative Commons: part | words of the name | words of the short form | versions
CREATIVE = """
by | attribution | by | 1.0 2.0 2.5 3.0 4.0
by-sa | attribution share ?alike | by sa | 1.0 2.0 2.5 3.0 4.0
by-nc | attribution non ?commercial | by nc | 1.0 2.0 2.5 3.0 4.0
by-nd | attribution no ?deriv(?:ative)?s? | by nd | 1.0 2.0 2.5 3.0 4.0
by-nc-sa | attribution non ?commercial share ?alike | by nc sa | 1.0 2.0 2.5 3.0 4.0
by-nc-nd | attribution non ?commercial no ?deriv(?:ative)?s? | by nc nd | 1.0 2.0 2.5 3.0 4.0
sa | share ?alike | sa | 1.0
nc | non ?commercial | nc | 1.0
nd | no ?deriv(?:ative)?s? | nd | 1.0
"""

NAMES = """
mit | mit | (?:the )?mit licen[cs]e
mit | expat | expat licen[cs]e
x11 | x11 | x11 licen[cs]e
isc | isc | isc licen[cs]e
bsd | bsd | bsd licen[cs]e
bsd-2-clause | bsd | bsd (?:2|two) clause(?: licen[cs]e)?
bsd-2-clause | bsd | (?:2|two) clause bsd(?: licen[cs]e)?
bsd-2-clause | bsd | (?:simplified|free)bsd? bsd licen[cs]e
bsd-3-clause | bsd | bsd (?:3|three) clause(?: licen[cs]e)?
bsd-3-clause | bsd | (?:3|three) clause bsd(?: licen[cs]e)?
bsd-3-clause | bsd | (?:new|revised|modified) bsd licen[cs]e
bsd-4-clause | bsd | (?:4|four) clause bsd(?: licen[cs]e)?
bsd-4-clause | bsd | original bsd licen[cs]e
0bsd | 0bsd | 0bsd
zlib | zlib | zlib(?: libpng)? licen[cs]e
libpng | libpng | libpng licen[cs]e
wtfpl | wtfpl | wtfpl
unlicense | unlicen | (?:the )?unlicense
beerware | beerware | beerware(?: licen[cs]e)?
cc0 | cc0 | cc0(?: 1 0)?
cc0 | zero | creative commons zero
public-domain | domain | public domain
public-domain | domain | (?:released|dedicated|placed|put) (?:in|into|to) the public domain
jpl | jpl | jpl image use policy
json | json | json licen[cs]e
curl | curl | curl licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
ruby | ruby | ruby licen[cs]e
perl | perl | same terms as perl itself
tcl | tcl | tcl tk licen[cs]e
icu | icu | icu licen[cs]e
w3c | w3c | w3c (?:software|document)(?: notice and)? licen[cs]e
mulan | mulan | mulan (?:permissive software|psl) licen[cs]e
etalab | etalab | licence ouverte(?: etalab)?
dl-de | datenlizenz | datenlizenz deutschland
gfdl | gfdl | gfdl
commons-clause | clause | commons clause
polyform | polyform | polyform (?:noncommercial|small business|strict)(?: licen[cs]e)?
shareware | shareware | shareware
freeware | freeware | freeware
eula | licen | end user licen[cs]e agreement
eula | eula | eula
proprietary | proprietary | proprietary licen[cs]e
proprietary | commercial | commercial licen[cs]e
dual | dual | dual licen[cs]ed
copyleft | copyleft | copyleft
"""

HINTS = """
copyright | copyright | copyright(?: c)? (?:19|20)[0-9][0-9]
copyright | copyright | copyright(?: c)?
licensed | licen | licen[cs]ed under
license | licen | licen[cs]e
see-license | licen | see (?:the )?licen[cs]e(?: file| txt| md)?
spdx | spdx | spdx license identifier(?: \\S+){1,4}
permission | permission | (?:used|reprinted|reproduced) (?:with|by) permission
rights | rights | some rights reserved
rights | rights | no rights reserved
trademark | trademark | (?:registered )?trademarks? of
"""


def _rows(block: str) -> list[list[str]]:
    return [[x.strip() for x in line.replace("\\\\", "\\").split(" | ")] for line in block.strip().splitlines()]


def rules() -> list[tuple[str, int, str, str]]:
    out = list(BASE)
    out += [(label, 0, key, pattern) for label, key, pattern in _rows(NOTICES)]
    for name, key, pattern, versions in _rows(FAMILIES):
        out += [(f"{name}-{v}", 1, key, f"{pattern}{_VERSION} {_dots(v)}") for v in versions.split()]
        out.append((name, 2, key, pattern))
    for part, long, short, versions in _rows(CREATIVE):
        for v in versions.split():
            out.append((f"cc-{part}-{v}", 1, "creative", f"creative commons {long}(?: licen[cs]e)?{_VERSION} {_dots(v)}"))
            out.append((f"cc-{part}-{v}", 1, "cc", f"cc {short}{_VERSION} {_dots(v)}"))
        out.append((f"cc-{part}", 2, "creative", f"creative commons {long}"))
        out.append((f"cc-{part}", 2, "cc", f"cc {short}"))
    out += [(label, 2, key, pattern) for label, key, pattern in _rows(NAMES)]
    out += [(label, 3, key, pattern) for label, key, pattern in _rows(HINTS)]
    return out


def _dots(version: str) -> str:
    """Words of a version: its last zero may be missing."""
    head, *tail = version.split(".")
    return head + "".join(f"(?: {x})?" if x == "0" else f" {x}" for x in tail)
