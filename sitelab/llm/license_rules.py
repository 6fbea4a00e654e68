"""The signature rules of the license scan.

All patterns run over normalised words: A-Z in lower case, one blank between words, one
before the first and one after the last. A rule matches whole words. ``keywords`` are
literals that every match holds; a rule is tried only on texts that hold them all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``rank`` orders detections, the smallest first; ``weight`` is the confidence of a match, which must hold ``holds``."""

    label: str
    rank: int
    weight: float
    keywords: tuple[str, ...]
    pattern: re.Pattern
    base: bool = False
    holds: str = ""


TEXT, TAG, NOTICE, NAME, REFERENCE, GENERIC = range(6)
WEIGHTS = (1.0, 0.95, 0.9, 0.7, 0.5, 0.3)

#: The phrases whose places are counted, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

LICENSE = "licen[cs]es?"
V = "(?:version |v)?"

#: label | keyword | identifier | name. Later versions and longer names are told apart by containment, not by order.
NAMES = f"""
mit | mit | mit | mit(?: x11| expat)?
mit-0 | mit | mit 0 | mit no attribution
x11 | x11 | x11 | x11
isc | isc | isc | isc
apache | apache | apache | apache(?: software)?
apache-1.1 | apache | apache 1 1 | apache(?: software)?(?: {LICENSE})? {V}1 1
apache-2 | apache | apache 2 0 | apache(?: software)?(?: {LICENSE})? {V}2(?: 0)?
bsd | bsd | bsd | bsd(?: style)?
bsd-2 | bsd | bsd 2 clause | (?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause
bsd-3 | bsd | bsd 3 clause | (?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause
bsd-4 | bsd | bsd 4 clause | (?:original|old|4 clause|four clause) bsd|bsd (?:4|four) clause
0bsd | bsd | 0bsd | (?:zero clause|0 clause|free public) bsd|0bsd
gpl | gpl | gpl | gnu gpl|gpl
gpl-1 | gpl | gpl 1 0(?: only| or later)? | (?:gnu )?gpl ?(?:version |v)1(?: 0)?
gpl-2 | gpl | gpl 2 0(?: only| or later)? | (?:gnu )?gpl ?(?:version |v)?2(?: 0)?
gpl-3 | gpl | gpl 3 0(?: only| or later)? | (?:gnu )?gpl ?(?:version |v)?3(?: 0)?
gpl | general public | gpl | (?:gnu )?general public
gpl-1 | general public | gpl 1 0 | (?:gnu )?general public(?: {LICENSE})? {V}1(?: 0)?
gpl-2 | general public | gpl 2 0 plus | (?:gnu )?general public(?: {LICENSE})? {V}2(?: 0)?
gpl-3 | general public | gpl 3 0 plus | (?:gnu )?general public(?: {LICENSE})? {V}3(?: 0)?
lgpl | lgpl | lgpl | gnu lgpl|lgpl
lgpl-2 | lgpl | lgpl 2 0(?: only| or later)? | (?:gnu )?lgpl ?(?:version |v)?2(?: 0)?
lgpl-2.1 | lgpl | lgpl 2 1(?: only| or later)? | (?:gnu )?lgpl ?(?:version |v)?2 1
lgpl-3 | lgpl | lgpl 3 0(?: only| or later)? | (?:gnu )?lgpl ?(?:version |v)?3(?: 0)?
lgpl | general public | lgpl | (?:gnu )?(?:lesser|library) general public
lgpl-2 | library general public | lgpl 2 0 plus | (?:gnu )?library general public(?: {LICENSE})? {V}2(?: 0)?
lgpl-2.1 | lesser general public | lgpl 2 1 plus | (?:gnu )?lesser general public(?: {LICENSE})? {V}2 1
lgpl-3 | lesser general public | lgpl 3 0 plus | (?:gnu )?lesser general public(?: {LICENSE})? {V}3(?: 0)?
agpl | agpl | agpl | gnu agpl|agpl
agpl-3 | agpl | agpl 3 0(?: only| or later)? | (?:gnu )?agpl ?(?:version |v)?3(?: 0)?
agpl | affero | agpl | (?:gnu )?affero general public
agpl-3 | affero | agpl 3 0 plus | (?:gnu )?affero general public(?: {LICENSE})? {V}3(?: 0)?
gfdl | free documentation | gfdl(?: 1 [123])?(?: only| or later)? | (?:gnu )?free documentation
mpl | mozilla | mpl | mozilla public
mpl-1.1 | mozilla | mpl 1 1 | mozilla public(?: {LICENSE})? {V}1 1
mpl-2 | mozilla | mpl 2 0 | mozilla public(?: {LICENSE})? {V}2(?: 0)?
mpl | mpl | mpl | mpl
mpl-1.1 | mpl | mpl 1 1 | mpl ?(?:version |v)?1 1
mpl-2 | mpl | mpl 2 0 | mpl ?(?:version |v)?2(?: 0)?
epl | eclipse | epl | eclipse public
epl-1 | eclipse | epl 1 0 | eclipse public(?: {LICENSE})? {V}1(?: 0)?
epl-2 | eclipse | epl 2 0 | eclipse public(?: {LICENSE})? {V}2(?: 0)?
edl-1 | eclipse | edl 1 0 | eclipse distribution(?: {LICENSE})? {V}1(?: 0)?
cddl | common development | cddl | common development and distribution
cddl-1 | cddl | cddl 1 [01] | cddl ?(?:version |v)?1(?: [01])?
cpl-1 | common public | cpl 1 0 | common public(?: {LICENSE})?(?: {V}1(?: 0)?)?
ibm-pl | ibm public | ipl 1 0 | ibm public
artistic | artistic | artistic | (?:perl )?artistic
artistic-1 | artistic | artistic 1 0(?: perl)? | (?:perl )?artistic(?: {LICENSE})? {V}1(?: 0)?
artistic-2 | artistic | artistic 2 0 | (?:perl )?artistic(?: {LICENSE})? {V}2(?: 0)?
zlib | zlib | zlib | zlib(?: libpng)?
libpng | libpng | libpng(?: 2 0)? | libpng
boost-1 | boost | bsl 1 0 | boost(?: software)?(?: {LICENSE})?(?: {V}1 0)?
busl-1.1 | business source | busl 1 1 | business source(?: {LICENSE})?(?: {V}1 1)?
sspl-1 | server side public | sspl 1 0 | server side public
elastic-2 | elastic | elastic 2 0 | elastic(?: {LICENSE})? {V}2(?: 0)?
unlicense | unlicense | unlicense | unlicense
wtfpl | wtfpl | wtfpl | wtfpl|do what the fuck you want to(?: public)?
cc0 | cc0 | cc0 1 0 | cc0(?: 1 0)?(?: universal)?
ofl-1.1 | sil open font | ofl 1 1 | sil open font(?: {LICENSE})?(?: {V}1 [01])?
psf | python | psf 2 0 | python software foundation|psf
python-2 | python | python 2 0 | python(?: {LICENSE})? {V}2 0
php-3 | php | php 3 0 1? | php(?: {LICENSE})? {V}3(?: 0 ?1?)?
ruby | ruby | ruby | ruby
vim | vim | vim | vim
postgresql | postgresql | postgresql | postgresql
openssl | openssl | openssl | openssl
ncsa | ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)?
afl-3 | academic free | afl 3 0 | academic free(?: {LICENSE})?(?: {V}3 0)?
osl-3 | open software | osl 3 0 | open software(?: {LICENSE})? {V}3 0
eupl | european union public | eupl 1 [012] | european union public(?: {LICENSE})?(?: {V}1 [012])?
cecill | cecill | cecill(?: 2 [01]| b| c)? | cecill(?: {V}2(?: [01])?| b| c)?
mulan-2 | mulan | mulanpsl 2 0 | mulan(?: psl| permissive software)(?: {LICENSE})?(?: v ?2)?
ms-pl | microsoft public | ms pl | microsoft public
ms-rl | microsoft reciprocal | ms rl | microsoft reciprocal
odbl-1 | open database | odbl 1 0 | open database(?: {LICENSE})?(?: {V}1 0)?
odc-by-1 | open data commons | odc by 1 0 | open data commons attribution
pddl-1 | public domain dedication and | pddl 1 0 | public domain dedication and
ogl-3 | open government | ogl uk 3 0 | open government(?: {LICENSE})?(?: {V}3(?: 0)?)?
qpl-1 | q public | qpl 1 0 | q public
upl-1 | universal permissive | upl 1 0 | universal permissive
watcom-1 | sybase open watcom | watcom 1 0 | sybase open watcom public
json | json | json | json
curl | curl | curl | curl
llama-2 | llama 2 | llama2 | llama 2 community
llama-3 | llama 3 | llama3 | (?:meta )?llama 3(?: 1| 2| 3)? community
openrail | openrail | openrail(?: m)? | (?:creativeml |bigscience )?openrail(?: m)?
gemma | gemma | gemma | gemma terms of use
"""

#: label | keyword | pattern: Creative Commons forms, which differ by their parts.
CREATIVE = f"""
cc-by | cc by | cc by(?: {V}[1-4] ?[05]?)?
cc-by-sa | cc by sa | cc by sa(?: {V}[1-4] ?[05]?)?
cc-by-nd | cc by nd | cc by nd(?: {V}[1-4] ?[05]?)?
cc-by-nc | cc by nc | cc by nc(?: {V}[1-4] ?[05]?)?
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: {V}[1-4] ?[05]?)?
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: {V}[1-4] ?[05]?)?
cc-by | creative commons | creative commons attribution(?: {LICENSE})?(?: [1-4] [05])?(?: international| unported)?
cc-by-sa | share | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?
cc-by-nd | deriv | creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?
cc-by-nc | commercial | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nc-sa | commercial | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd | commercial | creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?
cc-by | creativecommons org | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons org | creativecommons org licenses by sa [1-4] [05]
cc-by-nd | creativecommons org | creativecommons org licenses by nd [1-4] [05]
cc-by-nc | creativecommons org | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | creativecommons org | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons org | creativecommons org licenses by nc nd [1-4] [05]
cc0 | creativecommons org | creativecommons org publicdomain zero 1 0
cc-pdm | creativecommons org | creativecommons org publicdomain mark 1 0
cc0 | creative commons | creative commons (?:zero|0|cc0)(?: 1 0)?(?: universal)?
cc-unspecified | creative commons | creative commons {LICENSE}
"""

#: label | keyword | pattern: sentences that only a license text holds.
TEXTS = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | substantial portions of the software | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,200}to permit persons to whom the software is furnished to do so the software is provided
isc | with or without fee is hereby granted | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | with or without fee is hereby granted | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3 | to endorse or promote products | neither the name of .{1,120} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4 | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledg?e?ment
apache-2 | apache license | apache license version 2 0 january 2004
apache-2 | apache org licenses license 2 0 | apache org licenses license 2 0
apache-2 | you may not use this file except | you may not use this file except in compliance with the license
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation http www apache org
apache-2 | grant of patent license | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
gpl | free software foundation | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl-2 | version 2 | general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3 | version 3 | general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2 | version 2 june 1991 | gnu general public license version 2 june 1991
gpl-3 | version 3 29 june 2007 | gnu general public license version 3 29 june 2007
gpl | gnu org licenses | you should have received a copy of the gnu general public license along with this program
gpl-1 | version 1 february 1989 | gnu general public license version 1 february 1989
lgpl-2 | version 2 june 1991 | gnu library general public license version 2 june 1991
lgpl-2.1 | version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999
lgpl-3 | version 3 29 june 2007 | gnu lesser general public license version 3 29 june 2007
lgpl | lesser general public license | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by
lgpl | library general public license | you can redistribute it and or modify it under the terms of the gnu library general public license as published by
agpl-3 | version 3 19 november 2007 | gnu affero general public license version 3 19 november 2007
agpl | affero general public license | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by
gfdl | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant sections | with no invariant sections no front cover texts and no back cover texts
mpl-1.1 | mozilla org mpl | the contents of this file are subject to the mozilla public license version 1 1
mpl-2 | mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | mozilla org mpl 2 0 | if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0
epl-1 | eclipse public license | the accompanying program is provided under the terms of this eclipse public license
epl-1 | eclipse org legal epl v10 | eclipse org legal epl v10
epl-2 | eclipse org legal epl 2 0 | eclipse org legal epl 2 0
edl-1 | eclipse org org documents edl | eclipse org org documents edl v10
cddl-1 | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
cpl-1 | common public license | the accompanying program is provided under the terms of this common public license
artistic-1 | artistic license | the intent of this document is to state the conditions under which a package may be copied
artistic-2 | artistic license | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
zlib | in no event will the authors be held liable | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1 | boost software license | boost software license version 1 0 august 17th 2003
boost-1 | machine executable object code | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
boost-1 | boost org license 1 0 | boost org license 1 0(?: txt)?
busl-1.1 | business source license | the business source license this document or the license is not an open source license
busl-1.1 | additional use grant | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
sspl-1 | server side public license | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2 | elastic license | you may not provide the software to third parties as a hosted or managed service
unlicense | released into the public domain | this is free and unencumbered software released into the public domain
unlicense | unlicense org | for more information please refer to https? unlicense org
wtfpl | what the fuck | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
wtfpl | what the fuck | you just do what the fuck you want to
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
cc0 | waived all copyright | (?:has|have) waived all copyright and related or neighboring rights to
cc0 | associated cc0 with | the person who associated (?:a )?(?:work with this deed|cc0 with)
cc-by | licensed public rights | by exercising the licensed rights .{0,80}you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license
cc-by-nc | primarily intended for or directed | noncommercial means not primarily intended for or directed towards commercial advantage or monetary compensation
cc-by-sa | adapter s license | the adapter s license you apply must be a creative commons license with the same license elements
cc-by-nd | adapted material | for the avoidance of doubt you do not have permission under this public license to share adapted material
ofl-1.1 | reserved font name | no modified version of the font software may use the reserved font name
ofl-1.1 | font software | this font software is licensed under the sil open font license version 1 1
psf | psf is making python available | psf is making python available to licensee on an as is basis
psf | python software foundation | this license agreement is between the python software foundation psf and the individual or organization
python-2 | beopen | beopen python open source license agreement version 1
php-3 | php group | this product includes php software freely available from
ruby | ruby | you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices and associated disclaimers
vim | vim | there are no restrictions on distributing unmodified copies of vim
postgresql | written agreement is hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric young | this product includes cryptographic software written by eric young
ncsa | deal with the software without restriction | to deal with the software without restriction including without limitation the rights to use copy modify merge
afl-3 | academic free license | licensed under the academic free license version 3 0
osl-3 | open software license | licensed under the open software license version 3 0
eupl | european union public licence | licensed under the eupl
eupl | eupl | the work is provided under the terms of this licence when the licensor has placed the following notice
cecill | cecill | this software is governed by the cecill(?: b| c)? license under french law
mulan-2 | mulan psl v2 | is licensed under mulan psl v2
ms-pl | patent grant | this license governs use of the accompanying software if you use the software you accept this license
ms-rl | reciprocal grants | reciprocal grants for any file you distribute that contains code from the software
odbl-1 | open database license | is made available under the open database license
odbl-1 | opendatacommons org | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1 | opendatacommons org | opendatacommons org licenses by(?: 1 0)?
pddl-1 | opendatacommons org | opendatacommons org licenses pddl(?: 1 0)?
ogl-3 | open government | contains public sector information licensed under the open government licence v3 0
json | good not evil | the software shall be used for good not evil
curl | daniel stenberg | copyright c 1996 [0-9]{4} daniel stenberg
w3c | w3c | by obtaining using and or copying this work you .{0,60}agree that you have read understood and will comply with the following terms
bzip2 | julian r seward | copyright c 1996 [0-9]{4} julian r seward
libtiff | sam leffler | the names of sam leffler and silicon graphics may not be used in any advertising
unicode | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
llama-2 | llama 2 community license | llama 2 version release date july 18 2023
llama-3 | llama 3 | built with meta llama 3
openrail | use based restrictions | use based restrictions as referenced in paragraph 5
gemma | gemma | gemma is provided under and subject to the gemma terms of use
"""

#: label | keyword | pattern: terms without a license of their own.
GENERICS = """
all-rights-reserved | all rights reserved | all rights reserved
all-rights-reserved | rights reserved | (?:no|some) part of this (?:publication|book|work|website) may be reproduced
public-domain | public domain | (?:released|placed|dedicated|donated)(?: this work| it)? (?:in|into|to) the public domain
public-domain | public domain | (?:this work|this file|this document|it) is in the public domain
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized copying | unauthorized copying of this (?:file|document|software|work)(?: via any medium)? is strictly prohibited
proprietary | licensed not sold | (?:the )?software is licensed not sold
proprietary | end user license agreement | end user license agreement
non-commercial | commercial | (?:for|permitted for) (?:personal(?: and| or)? )?non ?commercial use only
non-commercial | commercial | not (?:for|permitted for) commercial use
research-only | research | (?:for )?(?:academic|research)(?: and (?:academic|research))?(?: purposes| use) only
copyleft | share alike | you must distribute (?:your contributions|derivative works) under the same license
source-available | source available | source available license
commercial | commercial license | (?:a )?commercial license (?:is|may be) (?:available|required|purchased)
dual | dual licensed | dual licensed under
evaluation | evaluation | for (?:evaluation|trial)(?: purposes)? only
no-ai-training | train | (?:may not|must not|shall not|do not) (?:be )?used? (?:this |the )?(?:content |work |data )?(?:for|to) (?:train|training)(?: of)?(?: any)? (?:ai|machine learning|artificial intelligence)
no-derivatives | derivative | no derivative works (?:are )?(?:permitted|allowed)
attribution | attribution | may be (?:used|shared|reproduced) with (?:proper )?attribution
royalty-free | royalty free | royalty free license
"""

GRANTED = (
    "(?:(?:re)?licensed|released|distributed|available|published|provided|covered|offered|issued|shared|redistributed|governed)"
    " (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"
)
UNDER = f"under(?: the)?(?: terms of)?(?: the)? (?:{{name}}) (?:{LICENSE}|terms)"


def _lines(block: str) -> list[list[str]]:
    return [[part.strip() for part in line.split(" | ")] for line in block.strip().splitlines()]


def _rule(label: str, rank: int, keywords: list[str], pattern: str, base: bool = False, holds: str = "") -> Rule:
    weight = 1.0 if base else WEIGHTS[rank]
    return Rule(label, rank, weight, tuple(keywords), re.compile(f" (?:{pattern})(?= )"), base, holds)


def all_rules() -> list[Rule]:
    """Base phrases first, then the families; equal ranks keep this order."""
    rules = [_rule(label, TEXT, [phrase], phrase, base=True) for phrase, label in BASE.items()]
    rules += [_rule(label, TEXT, [keyword], pattern) for label, keyword, pattern in _lines(TEXTS)]
    for label, keyword, identifier, name in _lines(NAMES):
        rules.append(_rule(label, TAG, ["spdx license identifier"], f"spdx license identifier (?:{identifier})"))
        rules.append(_rule(label, NOTICE, [keyword, "licens"], f"{GRANTED} (?:{name})(?: {LICENSE})?"))
        rules.append(_rule(label, NOTICE, [keyword, "under"], UNDER.format(name=name)))
        rules.append(_rule(label, NAME, [keyword, "licen"], f"(?:{name})(?: {LICENSE})?", holds="licen"))
        rules.append(_rule(label, NAME, ["license " + keyword], f"license (?:{identifier})"))
    for label, keyword, pattern in _lines(CREATIVE):
        rules.append(_rule(label, NOTICE, [keyword], f"{GRANTED}(?: a)? (?:{pattern})(?: {LICENSE})?"))
        rules.append(_rule(label, REFERENCE, [keyword], pattern))
    rules += [_rule(label, GENERIC, [keyword], pattern) for label, keyword, pattern in _lines(GENERICS)]
    return rules
