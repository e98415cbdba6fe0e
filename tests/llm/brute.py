"""Plain versions of the corpus operators, for tables that fit in memory."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingles(text: str | None, n: int) -> set[tuple]:
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def near_groups(docs: list[tuple[int, str | None]], n: int, percent: int = 80) -> dict[int, int]:
    """Smallest id of the group of every id."""
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered: set[int] = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def without_repeats(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, runs, sha256 of the rest) of every text."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, sha(bytes(b for b, g in zip(r, gone, strict=True) if not g))))
    return out


def edited(texts: list[str]) -> list[str]:
    """Texts in descending id order, each with its last third replaced by the head of the next."""
    out = []
    for t, u in zip(texts, [*texts[1:], *texts[:1]], strict=True):
        third = len(t) // 3
        out.append(t[: len(t) - third] + u[:third])
    return out


def notices(text, templates, threshold):
    """Every window of every size against every template; taken as licenses.notices says."""
    words = [w for w in re.sub(r"[\W_]+", " ", (text or "").lower()).split(" ") if w]
    pairs, found = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)], []
    for name, template in templates:
        own = [w for w in re.split(r"[^a-z0-9]+", template.lower()) if w]
        grams = {f"{a} {b}" for a, b in zip(own, own[1:], strict=False)}
        for i in range(len(pairs)):
            here = []
            for j in range(i, min(len(pairs), i + 2 * len(grams))):
                c, both = len(grams.intersection(pairs[i : j + 1])), j - i + 1 + len(grams)
                if 2 * c / both >= threshold:
                    here.append((both - 4 * c, -2 * c / both, i, name, j))
            found += [min(here)] if here else []
    taken = []
    for w in sorted(found):
        if all(o[2] > w[4] or w[2] > o[4] or (o[:3], o[4]) == (w[:3], w[4]) and o[3] != w[3] for o in taken):
            taken.append(w)
    return [(w[3], -w[1], w[2], w[4]) for w in taken]


def repair(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of damaged rows (turn, role, text) in order, by every stack without merging."""
    seen, faults = set(), []
    for _, role, text in rows:
        told = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    legal = re.compile("(s?(ua)+)?")
    # a prefix of roles is open if some ending makes it legal
    open_ = lambda s: bool(legal.fullmatch(s) or legal.fullmatch(s + "a") or legal.fullmatch(s + "ua"))
    ways = {"": [(0, "", ())]}  # roles so far: (cost, audit, repaired)

    def insert(ways):
        for _ in range(2):
            for roles, options in list(ways.items()):
                for c in "ua":
                    if open_(roles + c) and len(roles) < len(rows) + 3:
                        added = [(cost + 5, audit + "I", out + (f"{'user' if c == 'u' else 'assistant'}:",)) for cost, audit, out in options]
                        ways[roles + c] = [min(ways.get(roles + c, []) + added)]
        return ways

    for (_, role, text), fault in zip(rows, faults, strict=True):
        made: dict[str, list] = {}
        for roles, options in insert(ways).items():
            for cost, audit, out in options:
                made.setdefault(roles, []).append((cost + 2, audit + "D", out))
                if fault not in ("blank", "duplicate"):
                    late = 5 * (fault == "truncated")
                    for c, name, price, letter in ((role[:1], role, 0, "K"), ("u", "user", 1, "R"), ("a", "assistant", 1, "R")):
                        if c and open_(roles + c):
                            made.setdefault(roles + c, []).append((cost + price + late, audit + letter, (*out, f"{name}:{text}")))
        ways = {roles: [min(options)] for roles, options in made.items()}
    cost, audit, out = min(w for roles, options in insert(ways).items() if legal.fullmatch(roles) for w in options)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(out))


def damaged(rows: list[tuple]) -> list[tuple]:
    """Rows (conv, turn, role, text) after the damage that op13_repair does."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out
