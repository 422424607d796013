"""Plain Python versions of the operators that small inputs are checked against."""

from __future__ import annotations

import hashlib
import math
import re

from beatloom.llm import secrets as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    # The key words in either case of ASCII letters only.
    folded = "".join(c if c.isascii() else "�" for c in text)
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(folded) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", folded) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", folded) if m.end() - m.start() >= 24]
    return sorted(out)


def entropy_spans(text: str | None) -> list[tuple[int, int, int]]:
    out = []
    for m in re.finditer(S.RUN, text or ""):
        run = m[0]
        if not re.search("[0-9]", run) or re.match(S.ALLOWED_WHOLE, run):
            continue
        allowed = [x.span() for x in re.finditer(S.ALLOWED_PART, run)]
        bits = next(b for p, b in S.CLASSES if re.match(p, run))
        most = round(S.SCALE * S.WINDOW * (math.log2(S.WINDOW) - bits))
        found: list[list[int]] = []
        for a in range(len(run) - S.WINDOW + 1):
            w = run[a : a + S.WINDOW]
            if any(f < a + S.WINDOW and a < t for f, t in allowed):
                continue
            if sum(round(S.SCALE * n * math.log2(n)) for n in (w.count(c) for c in set(w))) <= most:
                if found and a <= found[-1][1]:
                    found[-1][1] = a + S.WINDOW
                else:
                    found.append([a, a + S.WINDOW])
        out += [(m.start() + a, 3, m.start() + b) for a, b in found]
    return out


def secret_row(text: str | None) -> tuple:
    name = lambda spans: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    base = base_spans(text)
    every = sorted(base + entropy_spans(text))
    count = [sum(k == j for _, k, _ in base) for j in range(3)]
    return (*count, hashlib.sha256(name(base).encode()).hexdigest(), name(every))
