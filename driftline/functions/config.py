"""Driver-side helpers: rule files, sizes, filter groups, backoff and host names."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from pathlib import Path

#: Nested quantifiers that rules may not have.
DANGEROUS = [r"(\w+)*", r"(a+)+", r"(.*)*", r"(\w*)*", r"(\d+)*", r"(.+)+", r"(\S+)*"]
MAX_PATTERN = 1000


@dataclass(frozen=True)
class Rule:
    allow: bool
    pattern: str


def java_regex(pattern: str) -> str:
    """A Java pattern that finds a match in the same texts as the RE2 pattern; what RE2 refuses raises ValueError."""
    return _Re2(pattern).java()


def needed(pattern: str) -> str:
    """A text that is part of every match of the RE2 pattern, "" where none is known: without it there is no need to look for a match."""
    p = _Re2(pattern)
    p.java()
    rare = [r for r in p.runs if len(r) > 1 or r and r != " " and not (r.isascii() and r.isalnum())]
    return "" if p.either else max(rare, key=len, default="")


#: Members of the named classes.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": r"\t-\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Java's own d and w are those of ASCII, looked up in a table; its s has one more.
_PERL = {"d": r"\d", "s": r"\t\n\f\r ", "w": r"\w"}
_CONTROL = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
_ANY = r"[\x{0}-\x{10FFFF}]"
_EDGE = {"b": r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))", "B": r"(?:(?=\w)(?<=\w)|(?!\w)(?<!\w))"}
#: The beginning of a line: Java's own, which is none at the text's end, and that one.
_LINE = r"(?:(?m:^)|\z(?<![^\n]))"


def _literal(code: int) -> str:
    return rf"\x{{{code:X}}}"


class _Re2:
    """One pass over an RE2 pattern. Only whether a text matches counts, so names of groups and greediness are left out."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0
        #: Characters outside groups, one after the other, that all matches have, unless there is a choice or case doesn't count.
        self.runs, self.either = [""], False
        #: Whether case doesn't count here. Then RE2's w has two signs that fold to letters, Java's doesn't, but its ranges do.
        self.fold = False

    def refuse(self, what: str):
        raise ValueError(f"{what} at {self.i} of {self.p!r}")

    def more(self, text: str) -> bool:
        """Whether text comes next, which is then passed."""
        if self.p.startswith(text, self.i):
            self.i += len(text)
            return True
        return False

    def next(self) -> str:
        if self.i >= len(self.p):
            self.refuse("the pattern breaks off")
        self.i += 1
        return self.p[self.i - 1]

    def match(self, regex: str):
        got = re.compile(regex).match(self.p, self.i)
        if got:
            self.i = got.end()
        return got

    def java(self) -> str:
        # Only a line feed ends a line; flags hold to the end of their group.
        out, flags, groups, repeatable = ["(?d)"], {"i": False, "m": False, "s": False}, [], False
        while self.i < len(self.p):
            c, start, self.fold = self.next(), self.i - 1, flags["i"]
            if c == "(":
                self.runs.append("")
                repeatable = False
                groups.append(dict(flags))
                if not self.more("?"):
                    out.append("(")
                elif self.match(r"P?<([A-Za-z0-9_]+)>"):
                    out.append("(")
                else:
                    got = self.match(r"([imsU]*)(-[imsU]+)?([:)])") or self.refuse("a group that RE2 does not have")
                    if not got[1] and not got[2] and got[3] == ")":
                        self.refuse("a group without flags")
                    self.either |= "i" in (got[1] or "")
                    flags = flags | {f: True for f in got[1] if f != "U"} | {f: False for f in (got[2] or "")[1:] if f != "U"}
                    on, off = "".join(f for f in "is" if flags[f]).replace("i", "iu"), "".join(f for f in "is" if not flags[f])
                    out.append(f"(?{on}{'-' if off else ''}{off}{got[3]}")
                    if got[3] == ")":
                        groups.pop()
                continue
            if c == ")":
                if not groups:
                    self.refuse("a group ends that has not begun")
                flags = groups.pop()
                out.append(c)
            elif c in "*+?" or c == "{" and (got := self.match(r"([0-9]+)(,([0-9]*))?\}")):
                if not repeatable:
                    self.refuse("nothing to repeat")
                if c == "{":
                    least, most = int(got[1]), int(got[3]) if got[3] else int(got[1])
                    if max(least, most) > 1000 or most < least:
                        self.refuse("a bad number of repeats")
                    c = got[0] if c in got[0] else c + got[0]
                self.runs[-1:] = [self.runs[-1] if c == "+" else self.runs[-1][:-1], ""]
                out.append(c + ("?" if self.more("?") else ""))
                repeatable = False
                continue
            elif c == "|":
                self.either |= not groups
                out.append(c)
                repeatable = False
                continue
            elif c == "[":
                out.append(self.class_())
            elif c == "\\":
                out.append(self.escape())
            elif c == "^":
                out.append(_LINE if flags["m"] else r"\A")
            elif c == "$":
                out.append("(?m:$)" if flags["m"] else r"\z")
            elif c == ".":
                out.append(c)
            else:
                out.append(c if c.isalnum() or ord(c) > 127 else _literal(ord(c)))
            repeatable = True
            if groups or c in "[.^$)" or c == "\\" and self.p[start + 1].isalnum():
                self.runs.append("")
            else:
                self.runs[-1] += self.p[self.i - 1]
        if groups:
            self.refuse("a group that does not end")
        return "".join(out)

    def escape(self) -> str:
        """What follows a backslash outside a class."""
        if self.more("Q"):
            end = self.p.find("\\E", self.i)
            text = self.p[self.i : end if end >= 0 else len(self.p)]
            self.i = end + 2 if end >= 0 else len(self.p)
            return "(?:" + "".join(_literal(ord(c)) for c in text[:-1]) + ")" * (len(text) > 0) + (_literal(ord(text[-1])) if text else ")") if text else "(?:)"
        c = self.p[self.i : self.i + 1]
        if c in ("A", "z"):
            self.i += 1
            return "\\" + c
        if c in ("b", "B"):
            self.i += 1
            return _EDGE[c]
        item, code = self.member()
        return item if code is None else _literal(code)

    def member(self) -> tuple[str, int | None]:
        """A class that a backslash begins, or the code of one character."""
        c = self.next()
        if c.lower() in _PERL:
            members = "0-9A-Za-z_" if self.fold and c in "wW" else _PERL[c.lower()]
            return f"[{'^' if c.isupper() else ''}{members}]", None
        if c in "pP":
            got = self.match(r"\{(\^?)([A-Za-z_]+)\}|()([A-Z])") or self.refuse("a bad property")
            name, inverse = got[2] or got[4], (c == "P") != bool(got[1])
            if name == "Any":
                return "[^\\x{0}-\\x{10FFFF}]" if inverse else _ANY, None
            return f"\\{'P' if inverse else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}", None
        if c == "x":
            got = self.match(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})") or self.refuse("a bad code")
            code = int(got[1] or got[2], 16)
            return ("", code) if code <= 0x10FFFF else self.refuse("a code beyond the last")
        if c in "01234567" and (c == "0" or self.p[self.i : self.i + 1] in [*"01234567"]):
            return "", int(c + self.match(r"[0-7]{0,2}")[0], 8)
        if c in _CONTROL:
            return "", _CONTROL[c]
        if c.isalnum() or ord(c) > 127:
            self.refuse(f"an escape that RE2 does not have, {c}")
        return "", ord(c)

    def class_(self) -> str:
        """The rest of a class behind its bracket."""
        inverse, items, first, nested = self.more("^"), [], True, self.fold
        while first or not self.more("]"):
            first = False
            got = self.match(r"\[:(\^?)([a-z]+):\]")
            if got:
                if got[2] not in POSIX:
                    self.refuse("a class without a name of the list")
                items.append(f"[^{POSIX[got[2]]}]" if got[1] else POSIX[got[2]])
                nested |= bool(got[1])
                continue
            item, low = self.one()
            if low is None:
                plain = item[1:-1] if item.startswith("[") and not item.startswith("[^") else ""
                items.append(plain or item)
                nested |= not plain
                continue
            high = low
            if self.p[self.i : self.i + 1] == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                self.i += 1
                _, high = self.one()
                if high is None or high < low:
                    self.refuse("a bad range")
            items.append(_literal(low) + (f"-{_literal(high)}" if high > low else ""))
        # Java's complement is that of the whole class only where no class stands inside it.
        union = "".join(items)
        return f"(?:(?![{union}]){_ANY})" if inverse and nested else f"[{'^' * inverse}{union}]"

    def one(self) -> tuple[str, int | None]:
        c = self.next()
        return self.member() if c == "\\" else ("", ord(c))


def load_rules(source: str) -> list[Rule]:
    """Rules of a file (a path under config/ or /, or *.txt) or of a comma-separated text."""
    lines = Path(source).read_text().splitlines() if source.startswith(("config/", "/")) or source.endswith(".txt") else source.split(",")
    rules = []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        action, colon, pattern = line.partition(":")
        action = action.strip().lower()
        if not colon or action not in ("allow", "deny"):
            raise ValueError(f"cannot read rule {line!r}: write allow or deny, a colon and a pattern; commas part the rules of a text, so use a file for patterns with commas")
        pattern = pattern.strip()
        if len(pattern) > MAX_PATTERN:
            raise ValueError(f"a pattern has at most {MAX_PATTERN} characters, not {len(pattern)}")
        for bad in DANGEROUS:
            if bad in pattern:
                raise ValueError(f"refused for its nested quantifier {bad}: {pattern!r}")
        java_regex(pattern)
        rules.append(Rule(action == "allow", pattern))
    return rules


def rules_summary(rules: list[Rule], default_allow: bool) -> str:
    shown = [f"{i + 1}. {'allow' if r.allow else 'deny'}: {r.pattern}" for i, r in enumerate(rules)]
    return "\n".join([f"{len(rules)} rules, default {'allow' if default_allow else 'deny'}", *shown])


def parse_size(text: str) -> int:
    """Bytes of 12, 12B, 3KiB, 3MiB, 3GiB or 3TiB."""
    found = re.fullmatch(r"([+-]?[0-9]+)(B|KiB|MiB|GiB|TiB)?", text)
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(found[1]) << {"KiB": 10, "MiB": 20, "GiB": 30, "TiB": 40}.get(found[2] or "B", 0)


class DeliverFilter:
    """Modulo groups: k is the distance of the groups; numbers n with ((n - 1) mod k) + 1 in the first group are delivered."""

    def __init__(self, config: str, floor_mod: bool = False):
        numbers = [int(x) for x in config.split(",")]
        if len(numbers) % 3:
            raise ValueError(f"a filter has three groups of equal size, not {len(numbers)} numbers")
        size = len(numbers) // 3
        self.groups = [numbers[i : i + size] for i in (0, size, 2 * size)]
        self.k, self.floor_mod = self.groups[1][0] - self.groups[0][0], floor_mod
        if self.groups[2][0] != self.groups[1][0] + self.k or not self.k:
            raise ValueError(f"groups begin at {[g[0] for g in self.groups]}, which is no constant distance")
        for n in range(1 if floor_mod else 0, self.groups[2][-1]):  # 0 is in no group, but floor_mod delivers it
            if self.delivers(n) != any(n in g for g in self.groups):
                raise ValueError(f"number {n} is not delivered as the groups say")

    def delivers(self, n: int) -> bool:
        m = (n - 1) % self.k if self.floor_mod else int(abs(n - 1) % abs(self.k)) * (1 if n >= 1 else -1)
        return m + 1 in self.groups[0]


def generate_filters(pipes: int, redundancies: int) -> list[list[int]]:
    """Filter numbers of each pipe, so that every event goes over redundancies + 1 pipes."""
    if pipes <= 0 or not 0 <= redundancies < pipes:
        raise ValueError("need pipes > 0 and 0 <= redundancies < pipes")
    rows = []
    for pipe in range(pipes):
        row = []
        for start in (1, 1 + pipes, 1 + 2 * pipes):  # three groups, each as long as there are pipes
            row += [start + (pipe + d) % pipes for d in range(redundancies + 1)]
        rows.append(row)
    return rows


def backoff_ms(attempt: int, base: int, most: int) -> int:
    """min(most, base * 2 ** (attempt - 1)), the first attempt at base."""
    base = max(0, base)
    return base if attempt <= 1 else min(max(base, most), base << min(attempt - 1, 30))


def jitter_ms(delay: int, percent: int, rng: random.Random | None = None) -> int:
    if delay <= 0 or percent <= 0:
        return max(0, delay)
    delta = max(1, round(delay * percent / 100))
    return (rng or random).randint(max(0, delay - delta), delay + delta)


def validate_retry(base: int, most: int, jitter: int, fail_fast: bool = False, startup: int = 1, interval: int = 1, timeout: int = 1) -> None:
    if base < 0:
        raise ValueError("backoff must be >= 0")
    if most < base:
        raise ValueError("largest backoff must be >= backoff")
    if not 0 <= jitter <= 100:
        raise ValueError("jitter must be between 0 and 100 percent")
    if fail_fast and min(startup, interval, timeout) <= 0:
        raise ValueError("fail-fast times must be > 0")


def host_of(server: str) -> str:
    """Host of host, host:port, PROTOCOL://host:port or [v6]:port."""
    text = server.strip().partition("://")[2] or server.strip()
    if text.startswith("["):
        return text[1:].partition("]")[0]
    return text.partition(":")[0] if text.count(":") == 1 else text


def missing_topics(wanted: str, existing: set[str]) -> list[str]:
    names = split_topics(wanted)
    return [n for n in names if n not in existing]


def split_topics(text: str) -> list[str]:
    names = [t.strip() for t in text.split(",") if t.strip()]
    if not names:
        raise ValueError("no topics configured")
    return names
