"""The rules of the license scan, made from families, names and sentence forms.

A rule is a regular expression over normalised text: lower-case words with one
space between them. It names the label, a keyword that every match holds, a
priority and a confidence.
"""

from __future__ import annotations

import re
from itertools import chain
from typing import NamedTuple

# Labels, the names by which licenses are known, with a word that
# each name holds, the versions they have, and their identifiers (hyphens and
# dots are spaces in normalised text).
FAMILIES = {
    "mit": (["mit licen[sc]e", "mit expat licen[sc]e", "expat licen[sc]e", "x11 licen[sc]e"], "licen", "", ["mit", "x11"]),
    "apache": (["apache licen[sc]e", "apache software licen[sc]e"], "apache", "2 0|1 1|1 0|2", ["apache 2 0", "apache 1 1"]),
    "gpl": (["gnu general public licen[sc]e", "general public licen[sc]e", "gnu gpl", "gplv[23]"], "g", "3 0|2 0|3|2|1", ["gpl 2 0", "gpl 3 0", "gpl 2 0 only", "gpl 3 0 or later"]),
    "lgpl": (["gnu lesser general public licen[sc]e", "lesser general public licen[sc]e", "library general public licen[sc]e", "gnu lgpl", "lgplv[23]"], "l", "3 0|2 1|2 0|3|2", ["lgpl 2 1", "lgpl 3 0"]),
    "agpl": (["gnu affero general public licen[sc]e", "affero general public licen[sc]e", "gnu agpl", "agplv3"], "a", "3 0|3|1 0", ["agpl 3 0"]),
    "mpl": (["mozilla public licen[sc]e"], "mozilla", "2 0|1 1|2", ["mpl 2 0", "mpl 1 1"]),
    "bsd": (["bsd licen[sc]e", "bsd style licen[sc]e", "[234] clause bsd licen[sc]e", "(?:new|modified|simplified|revised) bsd licen[sc]e"], "bsd", "", ["bsd 2 clause", "bsd 3 clause", "0bsd"]),
    "isc": (["isc licen[sc]e"], "isc", "", ["isc"]),
    "epl": (["eclipse public licen[sc]e"], "eclipse", "2 0|1 0|2|1", ["epl 1 0", "epl 2 0"]),
    "cddl": (["common development and distribution licen[sc]e"], "distribution", "1 1|1 0", ["cddl 1 0", "cddl 1 1"]),
    "cpl": (["common public licen[sc]e"], "common", "1 0", ["cpl 1 0"]),
    "eupl": (["european union public licen[sc]e"], "european", "1 2|1 1", ["eupl 1 1", "eupl 1 2"]),
    "cecill": (["cecill licen[sc]e", "licence cecill"], "cecill", "2 1|2 0", ["cecill 2 1"]),
    "unlicense": (["the unlicense", "unlicense"], "unlicense", "", ["unlicense"]),
    "wtfpl": (["do what the fuck you want to public licen[sc]e", "wtfpl"], "w", "2", ["wtfpl"]),
    "zlib": (["zlib licen[sc]e", "zlib libpng licen[sc]e"], "zlib", "", ["zlib"]),
    "bsl": (["boost software licen[sc]e"], "boost", "1 0", ["bsl 1 0"]),
    "busl": (["business source licen[sc]e"], "business", "1 1", ["busl 1 1"]),
    "sspl": (["server side public licen[sc]e"], "server", "1", ["sspl 1 0"]),
    "artistic": (["artistic licen[sc]e"], "artistic", "2 0|1 0", ["artistic 2 0"]),
    "ofl": (["sil open font licen[sc]e", "open font licen[sc]e"], "font", "1 1", ["ofl 1 1"]),
    "psf": (["python software foundation licen[sc]e", "psf licen[sc]e"], "licen", "2", ["psf 2 0"]),
    "ms-pl": (["microsoft public licen[sc]e"], "microsoft", "", ["ms pl"]),
    "ms-rl": (["microsoft reciprocal licen[sc]e"], "microsoft", "", ["ms rl"]),
    "odbl": (["open database licen[sc]e", "odc open database licen[sc]e"], "database", "1 0", ["odbl 1 0"]),
    "cc0": (["cc0", "creative commons zero", "cc zero"], "c", "1 0", ["cc0 1 0"]),
}
VERSIONS_OF_COMMONS = "4 0|3 0|2 5|2 0|1 0"
COMMONS = {
    "cc-by": ("by", "attribution"),
    "cc-by-sa": ("by sa", "attribution share ?alike"),
    "cc-by-nd": ("by nd", "attribution no ?deriv(?:ative|ative work|ate)?s"),
    "cc-by-nc": ("by nc", "attribution non ?commercial"),
    "cc-by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "cc-by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative|ative work|ate)?s"),
}
ADDRESSES = {
    "mit": ["opensource org licenses mit"],
    "apache": ["apache org licenses license 2 0", "apache org licenses"],
    "gpl": ["gnu org licenses gpl", "gnu org copyleft gpl"],
    "lgpl": ["gnu org licenses lgpl"],
    "agpl": ["gnu org licenses agpl"],
    "mpl": ["mozilla org mpl"],
    "bsd": ["opensource org licenses bsd"],
    "epl": ["eclipse org legal epl"],
    "unlicense": ["unlicense org"],
    "cc0": ["creativecommons org publicdomain zero"],
}
STATEMENTS = {
    "proprietary": ["all rights reserved", "proprietary and confidential", "may not be (?:copied|reproduced|redistributed) without"],
    "public-domain": ["(?:released|placed) (?:in|into) the public domain", "dedicated to the public domain"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy"],
    "bsd": ["redistribution and use in source and binary forms with or without modification"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose"],
}
GRANT = (
    "(?:re)?(?:licensed|released|distributed|available|provided|published|covered|governed|shared|issued|subject)"
    "(?: (?:under|by|with|to|in accordance with))?(?: the)?(?: terms(?: and conditions)? of)?(?: the| a| an)?"
)
class Rule(NamedTuple):
    rule: str
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def _literal(pattern: str, fallback: str) -> str:
    """The longest plain run of a pattern that every match holds."""
    plain = re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??|\[[^]]*\]\??|.\?", "\n", pattern)
    if "|" in plain:
        return fallback
    return max((x.strip() for x in plain.split("\n")), key=len) or fallback


def _numbered(name: str, versions: str) -> str:
    return f"{name}(?: version| v)? v?(?:{versions})"


def rules() -> list[Rule]:
    """Every rule: grants and identifiers (3), versions and addresses (2), bare names (1)."""
    found: list[tuple[str, str, str, int, float]] = []
    commons = {
        label: ([f"cc {short}", f"creative commons {long}"], "c", VERSIONS_OF_COMMONS, [f"cc {short} {v}" for v in VERSIONS_OF_COMMONS.split("|")])
        for label, (short, long) in COMMONS.items()
    }
    for label, (names, _, versions, ids) in chain(FAMILIES.items(), commons.items()):
        for name in names:
            if versions:
                found.append((label, "grant-version", f"{GRANT} {_numbered(name, versions)}", 3, 1.0))
                found.append((label, "version", _numbered(name, versions), 2, 0.9))
            found.append((label, "grant", f"{GRANT} {name}", 3, 0.95))
            found.append((label, "name", name, 1, 0.6))
        found += [(label, "identifier", f"spdx license identifier {x}", 3, 1.0) for x in ids]
    for label, (short, _) in COMMONS.items():
        found.append((label, "address", f"creativecommons org licenses {short}(?: (?:{VERSIONS_OF_COMMONS}))?", 2, 0.95))
    found += [(label, "address", x, 2, 0.9) for label, xs in ADDRESSES.items() for x in xs]
    found += [(label, "statement", x, 2, 0.8) for label, xs in STATEMENTS.items() for x in xs]
    out = []
    for i, (label, form, pattern, priority, confidence) in enumerate(found):
        core = pattern.removeprefix(GRANT)
        out.append(Rule(f"{i:03d}-{label}-{form}", label, _literal(core, "e"), f" (?:{pattern})(?= )", priority, confidence))
    return out


def _gate() -> str:
    """What a match of any rule holds, for lower-cased text that is not normalised:
    what is no letter or digit may stand between words. Rules that begin with
    another one's pattern add nothing."""
    words = re.compile("licen(?=[sc])")
    cores = {r.pattern.removeprefix(" (?:").removesuffix(")(?= )").removeprefix(GRANT).strip() for r in rules()}
    plain = sorted(x for x in cores if not words.search(x.replace("licen[sc]", "licens")))
    least = [x for i, x in enumerate(plain) if not any(x.startswith(y) for y in plain[:i])]
    return "|".join(["licen[sc]", *(x.replace(" ?", "[^a-z0-9]*").replace(" ", "[^a-z0-9]+") for x in least)])


#: A document without any of these has no license words (looked for in lower-cased text).
GATE = _gate()
