"""Signature rules of licences, built from tables of names, versions and sentence forms.

Rules match the words of a text in lower case, joined by single blanks: "CC BY-NC 4.0" reads
"cc by nc 4 0". Each rule has keywords, one of which must be among the words, and a priority: notices
that grant a licence go before plain mentions, exact versions before families.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

#: label: names (patterns over words), versions as label suffix: words
LICENSES: dict[str, tuple[list[str], dict[str, str]]] = {
    "apache": (["apache(?: software)?(?: foundation)?"], {"1.0": "1 0", "1.1": "1 1", "2.0": "2(?: 0)?"}),
    "mit": (["mit", "massachusetts institute of technology", "expat"], {}),
    "bsd": (["bsd", "berkeley software distribution"], {"0-clause": "(?:0|zero) clause", "2-clause": "(?:2|two) clause", "3-clause": "(?:3|three) clause", "4-clause": "(?:4|four) clause"}),
    "gpl": (["(?:gnu )?gpl", "(?:gnu )?general public"], {"1.0": "1(?: 0)?", "2.0": "2(?: 0)?", "3.0": "3(?: 0)?"}),
    "lgpl": (["(?:gnu )?lgpl", "(?:gnu )?(?:lesser|library) general public"], {"2.0": "2(?: 0)?", "2.1": "2 1", "3.0": "3(?: 0)?"}),
    "agpl": (["(?:gnu )?agpl", "(?:gnu )?affero general public"], {"1.0": "1(?: 0)?", "3.0": "3(?: 0)?"}),
    "gfdl": (["(?:gnu )?(?:gfdl|fdl)", "(?:gnu )?free documentation"], {"1.1": "1 1", "1.2": "1 2", "1.3": "1 3"}),
    "mpl": (["mpl", "mozilla public"], {"1.0": "1 0", "1.1": "1 1", "2.0": "2(?: 0)?"}),
    "epl": (["epl", "eclipse public"], {"1.0": "1(?: 0)?", "2.0": "2(?: 0)?"}),
    "eupl": (["eupl", "european union public"], {"1.1": "1 1", "1.2": "1 2"}),
    "cddl": (["cddl", "common development and distribution"], {"1.0": "1 0", "1.1": "1 1"}),
    "artistic": (["(?:perl )?artistic"], {"1.0": "1(?: 0)?", "2.0": "2(?: 0)?"}),
    "boost": (["boost(?: software)?", "bsl"], {"1.0": "1(?: 0)?"}),
    "isc": (["isc", "internet systems consortium"], {}),
    "zlib": (["zlib(?: libpng)?"], {}),
    "unlicense": (["unlicense"], {}),
    "wtfpl": (["wtfpl"], {"2.0": "2(?: 0)?"}),
    "psf": (["psf", "python software foundation"], {"2.0": "2(?: 0)?"}),
    "ofl": (["ofl", "(?:sil )?open font"], {"1.0": "1 0", "1.1": "1 1"}),
    "odbl": (["odbl", "open database"], {"1.0": "1 0"}),
    "cc0": (["cc0", "cc zero"], {"1.0": "1 0"}),
    "cc-by": (["cc by", "creative commons attribution"], {"2.0": "2 0", "2.5": "2 5", "3.0": "3 0", "4.0": "4 0"}),
    "cc-by-sa": (["cc by sa", "creative commons attribution share ?alike"], {"2.0": "2 0", "2.5": "2 5", "3.0": "3 0", "4.0": "4 0"}),
    "cc-by-nc": (["cc by nc", "creative commons attribution non ?commercial"], {"2.0": "2 0", "2.5": "2 5", "3.0": "3 0", "4.0": "4 0"}),
    "cc-by-nd": (["cc by nd", "creative commons attribution no ?deriv(?:ative)?s?"], {"2.0": "2 0", "3.0": "3 0", "4.0": "4 0"}),
    "cc-by-nc-sa": (["cc by nc sa", "creative commons attribution non ?commercial share ?alike"], {"2.0": "2 0", "3.0": "3 0", "4.0": "4 0"}),
    "cc-by-nc-nd": (["cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"], {"2.0": "2 0", "3.0": "3 0", "4.0": "4 0"}),
}

#: Words one of which every name of a licence has; where none are given, the label's first part.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "mit": ("mit", "massachusetts", "expat"),
    "bsd": ("bsd", "berkeley"),
    "gpl": ("gpl", "general"),
    "lgpl": ("lgpl", "lesser", "library"),
    "agpl": ("agpl", "affero"),
    "gfdl": ("gfdl", "fdl", "documentation"),
    "mpl": ("mpl", "mozilla"),
    "epl": ("epl", "eclipse"),
    "eupl": ("eupl", "european"),
    "cddl": ("cddl", "development"),
    "boost": ("boost", "bsl"),
    "isc": ("isc", "internet"),
    "psf": ("psf", "python"),
    "ofl": ("ofl", "font"),
    "odbl": ("odbl", "database"),
    "cc0": ("cc0", "cc"),
    "cc": ("cc", "creative"),
}

#: Sentence forms: priority, confidence, pattern around a licence's name. {n} name, {v} version.
EXACT = [
    (90, 1.0, r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?(?: agreement)?(?: v| version)? ?{v}"),
    (80, 0.95, r"spdx license identifier {n} {v}"),
    (70, 0.9, r"{n} licen[cs]e(?: v| version)? ?{v}"),
    (60, 0.8, r"{n}(?: v| version)? ?{v}"),
]
FAMILY = [
    (50, 0.9, r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?"),
    (45, 0.9, r"spdx license identifier {n}"),
    (40, 0.8, r"{n} licen[cs]e"),
]
#: Sentences that stand for themselves: label, priority, confidence, keyword, pattern.
SENTENCES = [
    ("mit", 75, 0.9, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 75, 0.9, "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 75, 0.9, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 76, 0.9, "contributors", r"neither the name of .{1,80}? nor the names of its contributors may be used"),
    ("apache-2.0", 75, 0.9, "compliance", r"you may not use this file except in compliance with the license"),
    ("gpl", 75, 0.9, "redistribute", r"this program is free software you can redistribute it and or modify it"),
    ("unlicense", 75, 0.9, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("boost-1.0", 75, 0.9, "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("warranty-disclaimer", 20, 0.5, "warranty", r"without (?:any )?warranty of any kind"),
    ("warranty-disclaimer", 20, 0.5, "warranties", r"without warranties or conditions of any kind"),
    ("public-domain", 30, 0.6, "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("reserved", 10, 0.4, "reserved", r"all rights reserved"),
    ("copyright", 5, 0.3, "copyright", r"copyright(?: c)? (?:19|20)\d\d"),
    ("proprietary", 15, 0.5, "proprietary", r"proprietary (?:and confidential )?(?:software|licen[cs]e|information)"),
    ("licence-notice", 2, 0.3, "licensed", r"licensed under"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    pattern: str
    keywords: tuple[str, ...]


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in order of priority: several hundred."""
    out = []
    for label, (names, versions) in LICENSES.items():
        first = label.split("-")[0]
        key = KEYWORDS.get(label) or KEYWORDS.get(first) or (first,)
        for name in names:
            for priority, confidence, form in FAMILY:
                out.append(Rule(label, priority + (name.count(" ")), confidence, form.format(n=name, v=""), key))
            for suffix, version in versions.items():
                for priority, confidence, form in EXACT:
                    out.append(Rule(f"{label}-{suffix}", priority + (name.count(" ")), confidence, form.format(n=name, v=version), key))
    for label, priority, confidence, keyword, pattern in SENTENCES:
        out.append(Rule(label, priority, confidence, pattern, (keyword,)))
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.pattern)))
