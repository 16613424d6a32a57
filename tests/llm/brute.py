"""Plain versions of the operators, from the words of their contracts."""

import hashlib
import re
import zlib
from collections import Counter

HIGH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontamination(docs, items):
    windows = {}
    for item, text in items:
        w = HIGH.findall(low(text or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item) if item is not None else "null")
    out = []
    for doc, text in docs:
        w, hit, found = HIGH.findall(low(text or "")), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in RULES.items()}


def pii(docs):
    out = []
    for doc, text in docs:
        spans = base_spans(text)
        out.append((doc, *map(len, spans.values()), sha(",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v))))
    return out


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def token_output(docs):
    """For rows in their final order."""
    import numpy as np

    encode, at, out = library("word_bpe_49k.json"), 0, []
    for doc, text in docs:
        ids = [*encode(text), 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def token_counts(docs):
    encode = library("byte_bpe_50k.json")
    return [(doc, len((text or "").encode()), n := len(encode(text)), n > 1024) for doc, text in docs]


def shingles(text, width=4):
    w = PLAIN.findall(low(text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def join(docs, width=4, percent=85):
    """(doc_id, n_shingles, component_id), every pair of different sets compared."""
    sets = {}
    for doc, text in docs:
        sets.setdefault(frozenset(shingles(text, width)), []).append(doc)
    keys = [k for k in sets if k]
    label = {k: i for i, k in enumerate(keys)}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            c = len(a & b)
            if 100 * c >= percent * len(a | b) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = {k: new if v == old else v for k, v in label.items()}
    least = {}
    for k in keys:
        ids = [d for d in sets[k] if d is not None]
        least.setdefault(label[k], []).extend(ids)
    return [(doc, len(s), min(least[label[s]], default=None) if s else doc) for doc, text in docs for s in [frozenset(shingles(text, width))]]


def quality(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        w = PLAIN.findall(text)
        n = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if PLAIN.search(line):
                dup += line in seen
                seen.add(line)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    return out


def line_dedup(docs):
    """Null ids are one document behind all others."""
    last = float("inf")
    key = lambda line: low(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    at = lambda doc: last if doc is None else doc
    holders = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(at(doc))
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == at(doc)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out
