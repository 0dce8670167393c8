"""Account-code prefixes: pattern, standard code, confidence."""

from __future__ import annotations

import re
from itertools import product

# Fixed values, in the order in which they are listed; the longer pattern text wins, then the earlier one.
GUION = [
    ("1-01", "AC", 0.85), ("1-01-01", "AC.01", 0.97), ("1-01-02", "AC.02", 0.93), ("1-01-03", "AC.02", 0.90), ("1-01-04", "AC.03", 0.97),
    ("1-01-05", "AC.04", 0.95), ("1-01-06", "AC.07", 0.90), ("1-01-07", "AC.06", 0.95), ("1-01-08", "AC.05", 0.97), ("1-01-09", "AC.07", 0.93),
    ("1-01-10", "AC.07", 0.90), ("1-01-11", "ANC.06", 0.88), ("1-02-01", "ANC.01", 0.97), ("1-02-02", "ANC.01", 0.97), ("1-02-03", "ANC.01", 0.97),
    ("1-02-04", "ANC.01", 0.97), ("1-02-05", "ANC.01", 0.97), ("1-02-06", "ANC.03", 0.95), ("1-02-07", "ANC.04", 0.93), ("1-03", "ANC.05", 0.92),
    ("2-01-01", "PC.02", 0.97), ("2-01-02", "PC.03", 0.95), ("2-01-03", "PC.01", 0.97), ("2-01-04", "PC.07", 0.95), ("2-01-05", "PC.04", 0.97),
    ("2-01-06", "PC.08", 0.90), ("2-01-07", "PC.08", 0.90), ("2-01-08", "PC.06", 0.97), ("2-01-09", "PC.05", 0.97), ("2-01-10", "PC.08", 0.88),
    ("2-01-11", "PC.08", 0.85), ("2-01-12", "PC.05", 0.93), ("2-01-13", "PC.08", 0.88), ("2-01-14", "PC.08", 0.87), ("2-02-01", "PNC.01", 0.97),
    ("2-02-02", "PNC.02", 0.97), ("2-02-03", "PNC.03", 0.95), ("2-02-04", "PNC.04", 0.95), ("2-02-05", "PNC.05", 0.90), ("3-01-01", "PAT.01", 0.97),
    ("3-01-02", "PAT.01", 0.93), ("3-01-03", "PAT.02", 0.95), ("3-01-04", "PAT.02", 0.93), ("3-01-05", "PAT.03", 0.93), ("3-01-06", "PAT.03", 0.95),
    ("3-02", "PAT.03", 0.90), ("3-03", "PAT.04", 0.95), ("3-07", "PAT.04", 0.93), ("4-01", "ER.01", 0.96), ("4-02", "ER.01", 0.93),
    ("5-01", "ER.02", 0.97), ("6-01-01", "ER.04", 0.93), ("6-01-02", "ER.04", 0.90), ("6-01-03", "ER.04", 0.95), ("6-01-04", "ER.07", 0.97),
    ("6-01-05", "ER.04", 0.90), ("6-01-06", "ER.05", 0.95), ("7-01", "ER.01", 0.88), ("8-01", "ER.09", 0.95), ("8-02", "ER.09", 0.90),
    ("9-03", "ER.10", 0.97),
]
COMPACTO = [
    ("111[0-9]", "AC.01", 0.97), ("112[0-9]", "AC.01", 0.97), ("113[0-9]", "AC.07", 0.93), ("114[0-9]", "AC.03", 0.95), ("115[0-9]", "AC.06", 0.95),
    ("116[0-9]", "AC.05", 0.97), ("117[0-9]", "AC.04", 0.93), ("118[0-9]", "AC.07", 0.95), ("119[0-9]", "ANC.06", 0.88), ("121[0-9]", "ANC.01", 0.95),
    ("122[0-9]", "ANC.01", 0.97), ("123[0-9]", "ANC.04", 0.93), ("1010[0-9]", "AC.01", 0.97), ("1011[0-9]", "AC.07", 0.93),
    ("102[0-9]", "ANC.01", 0.97), ("103[0-9]", "AC.06", 0.93), ("213[0-9]", "PC.01", 0.95), ("214[0-9]", "PC.07", 0.95), ("217[0-9]", "PC.05", 0.97),
    ("201[0-9]", "PC.02", 0.95), ("202[0-9]", "PC.01", 0.93), ("2010[12]", "PC.02", 0.95), ("2010[3-9]", "PC.05", 0.93), ("2020", "PNC.01", 0.95),
    ("203[0-9]", "PAT.01", 0.95), ("317[0-9]", "PAT.01", 0.97), ("411[0-9]", "ER.01", 0.97), ("401[0-9]", "ER.01", 0.97), ("402[0-9]", "ER.01", 0.90),
    ("301[0-9]", "ER.04", 0.85), ("302[0-9]", "ER.04", 0.88), ("404[0-9]", "ER.09", 0.85), ("511[0-9]", "ER.02", 0.97), ("611[0-9]", "ER.04", 0.95),
    ("812[0-9]", "ER.09", 0.97), ("815[0-9]", "ER.10", 0.95),
]
PUNTO = [
    ("1.01", "AC", 0.85), ("1.01.01", "AC.01", 0.97), ("1.01.02", "AC.02", 0.93), ("1.01.05", "AC.03", 0.97), ("1.01.06", "AC.07", 0.92),
    ("1.01.07", "AC.07", 0.92), ("1.01.09", "AC.05", 0.97), ("1.01.10", "AC.07", 0.93), ("1.01.11", "AC.07", 0.90), ("1.02", "ANC.01", 0.95),
    ("1.02.01", "ANC.01", 0.97), ("1.02.02", "ANC.01", 0.97), ("1.02.03", "ANC.01", 0.97), ("1.02.04", "ANC.01", 0.97), ("1.02.06", "ANC.01", 0.97),
    ("1.03", "ANC.05", 0.90), ("2.01.01", "PC.02", 0.97), ("2.01.07", "PC.01", 0.97), ("2.01.06", "PC.04", 0.97), ("2.01.08", "PC.06", 0.97),
    ("2.01.12", "PC.05", 0.97), ("2.01.14", "PC.08", 0.90), ("2.02.01", "PNC.01", 0.97), ("2.03.01", "PAT.01", 0.97), ("2.03.02", "PAT.01", 0.93),
    ("2.03.06", "PAT.03", 0.95), ("2.03.07", "PAT.04", 0.97), ("3.01", "ER.01", 0.95), ("3.02", "ER.01", 0.88), ("4.01", "ER.02", 0.95),
    ("4.02", "ER.04", 0.93), ("4.03.01", "ER.10", 0.97),
]
LISTED = {"guion": GUION, "compacto": COMPACTO, "punto": PUNTO}


def literals(pattern: str) -> list[str]:
    """The literal prefixes that a pattern stands for."""
    parts = [[p] if "[" not in p else [c for c in "0123456789" if re.fullmatch(p, c)] for p in re.findall(r"\[[^\]]*\]|[^\[]+", pattern)]
    return ["".join(x) for x in product(*parts)]


def expanded() -> list[tuple[str, str, str, float]]:
    """(format, literal prefix, code, confidence), unique per format: what a pattern tried before covers is left out."""
    out = []
    for fmt, listed in LISTED.items():
        taken: set[str] = set()
        for pattern, code, conf in sorted(listed, key=lambda e: -len(e[0])):
            found = [p for p in literals(pattern) if not any(p[:n] in taken for n in range(1, len(p) + 1))]
            out += [(fmt, p, code, conf) for p in found]
            taken.update(found)
    return out
