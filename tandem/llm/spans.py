"""Spans in texts: finders that scan whole texts in one pass, and their written form."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence

Span = tuple[int, int, int]  # start, end (exclusive), kind

#: Patterns that results must agree with (fixed values).
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEXES = bytes(chr(i) in "0123456789abcdef" for i in range(256))  # 1 for what stands in _HEX
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

PII = ("email", "ip", "card", "phone")
SECRETS = ("assign", "access", "hex")


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """Each @ with a domain behind it takes the local part in front of it, back to the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            left = at
            while left > end and text[left - 1] in _LOCAL:
                left -= 1
            if left < at:
                end = domain.end()
                yield left, end
        at = text.find("@", max(at + 1, end))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def pii_spans(text: str) -> list[Span]:
    """E-mail addresses, IP addresses, payment cards and phone numbers, by start and kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), 2))
        out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def secret_spans(text: str) -> list[Span]:
    """Assigned secrets, access keys and long hexadecimal runs, by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out = [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(*m.span(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"\1" * 24 in text.encode("utf-8", "replace").translate(_HEXES):
        out += [(*m.span(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def written(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in spans)


def digest(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    return hashlib.sha256(written(spans, kinds).encode()).hexdigest()


def overlaps(span: Span, others: Sequence[Span]) -> bool:
    return any(a < span[1] and span[0] < b for a, b, _ in others)
