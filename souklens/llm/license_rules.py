"""Signature rules of the license scan, in words: lower-case, one space between words, ``@`` before the word that gates the rule.

Every rule is (label, priority, confidence, regex); a smaller priority is stronger. The gate is the word after ``@``. Families are
written out by hand; versions and variants come from their rules.
"""

from __future__ import annotations

import re

TAG, FULL, NAME, CLAUSE, MENTION = 0, 1, 2, 3, 4
CONFIDENCE = {TAG: 1.0, FULL: 0.95, NAME: 0.85, CLAUSE: 0.8, MENTION: 0.6}

# The base phrases and their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# Identifiers of common licenses.
IDENTIFIERS = """0BSD AAL AFL-2.1 AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0
Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CATOSL-1.1
CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CNRI-Python CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUDatagrid
EUPL-1.1 EUPL-1.2 Fair Frameworx-1.0 FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND
ICU IJG Imlib2 IPA IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT
MIT-0 MIT-CMU MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NASA-1.3 NCSA NPOSL-3.0 NTP OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0
QPL-1.0 RPL-1.5 Ruby SISSL SSPL-1.0 UPL-1.0 Unlicense Vim VSL-1.0 W3C WTFPL X11 Xnet Zend-2.0 Zlib ZPL-2.1""".split()

ANY = r"(?:\w+ ){0,3}"


def _words(text: str) -> str:
    return " ".join(re.findall(r"[0-9a-z]+", text.lower()))


def _tags():
    for name in IDENTIFIERS:
        label = name.removesuffix("-only").removesuffix("-or-later").lower()
        yield label, TAG, rf"spdx license @identifier {_words(name)}"
        yield label, FULL, rf"@licensed under (?:the )?(?:terms of )?(?:the )?{_words(name)}"
        if "-" in name:
            yield label, NAME, rf"{_words(name)} @license"


def _gnu():
    for short, title, versions in (("gpl", "general public", ("1", "2", "3")), ("lgpl", "(?:lesser|library) general public", ("2", "2 1", "3")), ("agpl", "affero general public", ("3",))):
        yield short, NAME, rf"(?:gnu )?{title} @license"
        yield short, MENTION, rf"gnu @{short}"
        yield short, CLAUSE, rf"{title} @license as published by the free software foundation"
        for v in versions:
            label = f"{short}-{v.replace(' ', '.')}" + ("" if " " in v else ".0")
            yield label, FULL, rf"(?:gnu )?{title} @license (?:as published by the free software foundation )?(?:either )?(?:version|v) {v}(?: 0)?"
            yield label, FULL, rf"(?:gnu )?{title} @license v{v}(?: 0)?"
            yield label, FULL, rf"version {v}(?: 0)? of the (?:gnu )?{title} @license"
            yield label, NAME, rf"(?:gnu )?@{short} ?v?{v}(?: 0)?"
            yield label, NAME, rf"(?:gnu )?@{short} version {v}(?: 0)?"
    yield "gfdl", NAME, r"(?:gnu )?free documentation @license"
    for v in ("1 1", "1 2", "1 3"):
        yield f"gfdl-{v.replace(' ', '.')}", FULL, rf"(?:gnu )?free documentation @license (?:version|v) {v}"


def _creative_commons():
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?"}
    for kinds in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        short, title = " ".join(kinds), " ".join(parts[k] for k in kinds)
        label = f"cc-{'-'.join(kinds)}"
        yield label, NAME, rf"creative commons {title} @license"
        yield label, MENTION, rf"@licensed under (?:a |the )?cc {short}"
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            to = f"{label}-{v.replace(' ', '.')}"
            yield to, FULL, rf"(?:creative commons )?{title} {v} {ANY}@license"
            yield to, FULL, rf"@licensed under {ANY}cc {short} {v}"
    yield "cc0-1.0", FULL, r"@cc0 1 0 universal"
    yield "cc0-1.0", NAME, r"creative commons zero @license"
    yield "cc0-1.0", MENTION, r"@licensed under cc0"


def _by_hand():
    yield "mit", NAME, r"mit @license"
    yield "mit", NAME, r"@licensed under (?:the )?(?:terms of the )?mit(?: license)?"
    yield "mit", MENTION, r"mit style @license"
    yield "mit", CLAUSE, r"@permission is hereby granted free of charge to any person obtaining a copy"
    yield "mit", CLAUSE, r"the above @copyright notice and this permission notice shall be included in all copies"
    yield "mit", CLAUSE, r"the software is provided as is without @warranty of any kind express or implied"
    yield "mit-0", FULL, r"mit no attribution @license"
    yield "x11", NAME, r"x11 @license"
    yield "expat", NAME, r"expat @license"
    yield "isc", NAME, r"isc @license"
    yield "isc", CLAUSE, r"@permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    yield "ntp", CLAUSE, r"@permission to use copy modify and distribute this software and its documentation for any purpose"
    yield "apache", NAME, r"apache @license"
    yield "apache", NAME, r"apache software @license"
    yield "apache", NAME, r"@licensed to the apache software foundation asf under one or more"
    for v in ("1 0", "1 1", "2 0"):
        label = f"apache-{v.replace(' ', '.')}"
        yield label, FULL, rf"apache (?:software )?@license (?:version |v )?{v}"
        yield label, FULL, rf"apache (?:software )?@license v{v}"
        yield label, FULL, rf"@licensed under (?:the )?apache (?:software )?(?:license )?(?:version )?{v}"
    yield "apache-2.0", CLAUSE, r"you may not use this file except in compliance with the @license"
    yield "apache-2.0", CLAUSE, r"unless required by applicable law or agreed to in writing software distributed under the @license is distributed on an as is basis"
    yield "bsd", NAME, r"(?:new |modified |simplified |revised |original )?bsd @license"
    yield "bsd", MENTION, r"bsd style @license"
    yield "bsd", NAME, r"@licensed under (?:the )?(?:terms of the )?bsd"
    for n, word in (("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        yield f"bsd-{n}-clause", FULL, rf"bsd {n} clause @license"
        yield f"bsd-{n}-clause", FULL, rf"(?:{n}|{word}) clause bsd @license"
        yield f"bsd-{n}-clause", FULL, rf"bsd @license {n} clause"
    yield "bsd-2-clause", FULL, r"(?:simplified|freebsd) (?:bsd )?@license"
    yield "bsd-3-clause", FULL, r"(?:new|modified|revised) bsd @license"
    yield "bsd-4-clause", FULL, r"original bsd @license"
    yield "bsd", CLAUSE, r"@redistribution and use in source and binary forms with or without modification are permitted"
    yield "bsd", CLAUSE, r"@redistributions of source code must retain the above copyright notice"
    yield "bsd", CLAUSE, r"@redistributions in binary form must reproduce the above copyright notice"
    yield "bsd-3-clause", CLAUSE, r"may be used to endorse or promote products derived from this software without specific prior written @permission"
    yield "bsd-4-clause", CLAUSE, r"all @advertising materials mentioning features or use of this software must display"
    yield "0bsd", NAME, r"zero clause bsd @license"
    yield "gpl", CLAUSE, r"this program is free software you can @redistribute it and or modify it"
    yield "gpl", CLAUSE, r"without even the implied @warranty of merchantability or fitness for a particular purpose"
    yield "gpl", CLAUSE, r"you should have received a copy of the gnu general public @license"
    yield "lgpl", CLAUSE, r"you should have received a copy of the gnu (?:lesser|library) general public @license"
    yield "agpl", CLAUSE, r"you should have received a copy of the gnu affero general public @license"
    yield "gpl-2.0", CLAUSE, r"either version 2 of the @license or at your option any later version"
    yield "gpl-3.0", CLAUSE, r"either version 3 of the @license or at your option any later version"
    for label, title in (("mpl", "mozilla public"), ("epl", "eclipse public"), ("cpl", "common public"), ("eupl", "european union public"), ("osl", "open software"), ("afl", "academic free"),
                         ("ofl", "(?:sil )?open font"), ("cddl", "common development and distribution"), ("artistic", "artistic"), ("lppl", "latex project public"), ("apsl", "apple public source"),
                         ("bsl", "boost software"), ("busl", "business source"), ("sspl", "server side public"), ("elastic", "elastic"), ("ms-pl", "microsoft public"), ("ms-rl", "microsoft reciprocal"),
                         ("rpl", "reciprocal public"), ("qpl", "q public"), ("npl", "netscape public"), ("ipl", "ibm public"), ("spl", "sun public"), ("sissl", "sun industry standards source"), ("php", "php"),
                         ("zpl", "zope public"), ("psf", "python software foundation"), ("ruby", "ruby"), ("vim", "vim"), ("zlib", "zlib"), ("libpng", "libpng"), ("openssl", "openssl"), ("ftl", "freetype project"),
                         ("ncsa", "university of illinois ncsa open source"), ("upl", "universal permissive"), ("ecl", "educational community"), ("cecill", "cecill"), ("mulan", "mulan permissive software"),
                         ("odbl", "open database"), ("odc-by", "open data commons attribution"), ("pddl", "public domain dedication and"), ("cpal", "common public attribution"), ("nasa", "nasa open source"),
                         ("postgresql", "postgresql"), ("json", "json"), ("beerware", "beer ?ware"), ("icu", "icu"), ("w3c", "w3c software"), ("hpnd", "historical permission notice and disclaimer"), ("openrail", "openrail"), ("llama", "llama (?:\\d )?community")):
        yield label, NAME, rf"{title} @license"
        yield label, FULL, rf"{title} @license (?:version |v )?\d+(?: \d+)?"
        yield label, NAME, rf"@licensed under (?:the )?(?:terms of the )?{title} license"
    yield "mpl-2.0", CLAUSE, r"this source code form is subject to the terms of the mozilla public @license v 2 0"
    yield "bsl-1.0", CLAUSE, r"distributed under the boost software @license version 1 0"
    yield "zlib", CLAUSE, r"@permission is granted to anyone to use this software for any purpose including commercial applications"
    yield "unlicense", CLAUSE, r"this is free and unencumbered software released into the public @domain"
    yield "unlicense", NAME, r"the @unlicense"
    yield "public-domain", NAME, r"(?:released|placed|dedicated) (?:in|into|to) the public @domain"
    yield "wtfpl", NAME, r"do what the fuck you want to public @license"
    yield "proprietary", CLAUSE, r"@copyright (?:c )?(?:\d+ )?" + ANY + r"all rights reserved"
    yield "proprietary", NAME, r"(?:proprietary|commercial|end user) @license(?: agreement)?"
    yield "custom", MENTION, r"see the @license file"
    yield "custom", MENTION, r"@licensed under"
    yield "custom", MENTION, r"@license agreement"


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, confidence, gate word, regex) of all rules."""
    out = []
    for label, priority, regex in (*_tags(), *_gnu(), *_creative_commons(), *_by_hand()):
        gate = re.search(r"@(\w+)", regex)[1]
        out.append((label, priority, CONFIDENCE[priority], gate, rf"(?:^| )({regex})(?= |$)"))
    return out
