"""Plain re-statements of the greedy and ranking rules, for comparison on small texts."""

from __future__ import annotations

import math
import random

import regex

WORDS = "ore tan mil rod sea key map fog arc sun dew ash elm oak ivy".split()


def cut(text):
    found, start = [], 0
    text = text.strip()
    for m in regex.finditer(r"[.!?](\s+)", text):
        found.append(text[start:m.start(1)])
        start = m.end()
    found.append(text[start:])
    return [s.strip() for s in found if s.strip()]


def tokens(s, least):
    return regex.findall(r"[\p{L}\p{N}_]{%d,}" % least, s.lower())


def overlap(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def redundant(text, limit=0.55):
    ss = cut(text)
    if len(ss) <= 2:
        return text
    kept = []
    for s in ss:
        ws = tokens(s, 3)
        features = set(ws), set(zip(ws, ws[1:]))
        if ws and all(max(overlap(x, y) for x, y in zip(features, k[1])) <= limit for k in kept):
            kept.append((s, features))
    return " ".join(s for s, _ in kept)


def redundant_plain(text, limit=0.7):
    kept = []
    for s in regex.sub(r"([.!?])\s+", "\\1\x00", text.strip()).split("\x00"):
        ws = set(tokens(s, 1))
        if all(overlap(ws, k) <= limit for _, k in kept):
            kept.append((s, ws))
    return " ".join(s for s, _ in kept)


def tfidf(text, share=0.35):
    ss = cut(text)
    n = len(ss)
    if n <= 2:
        return text
    bags = [tokens(s, 4) for s in ss]
    scores = {}
    for i, s in enumerate(ss):
        total = sum(math.log((n + 1) / (1 + sum(w in b for b in bags))) for w in bags[i])
        total /= max(1, len(s.split()))
        total *= 1.8 if i in (0, n - 1) else 1
        total *= 1.5 if s.endswith("?") else 1
        total *= 1.2 if regex.search(r"(?<![\p{L}\p{N}_])\p{Nd}+(?![\p{L}\p{N}_])", s) else 1
        scores[i] = round(total, 9)
    room = max(2, int(n * share))
    best = sorted(scores, key=lambda i: (i not in (0, n - 1), -scores[i], -i))[:room]
    return " ".join(ss[i] for i in sorted(best))


def condense(text):
    flat = regex.sub(r"(?m)^\s*[-*•]\s+", "\n", text)
    flat = regex.sub(r"(?m)^\s*\d+[.)\s]\s+", "\n", flat)
    size, ss = len(flat.split()), cut(flat)
    n = len(ss)
    if size < 60 or n <= 2:
        return text
    every = tokens(flat, 4)
    count = {w: every.count(w) for w in every}

    def score(s):
        ws = tokens(s, 4)
        return round(sum(count[w] / n * math.log(n / count[w]) for w in ws) / max(1, len(ws)), 9)

    room = min(max(2, size // 50), n - 1)
    best = sorted(range(n), key=lambda i: (i != 0, -score(ss[i]), i))[:room]
    return " ".join(ss[i] for i in sorted(best))


def pack(text):
    goal = max(200, len(text) // 15)
    done, held = [], []
    for part in regex.split(r"\n\s*\n|\n(?=#{1,6}\s)", text):
        if part.strip():
            held.append(part.strip())
            if sum(map(len, held)) >= goal:
                done.append("\n".join(held))
                held = []
    return done + (["\n".join(held)] if held else [])


def reachable(source):
    out, barrier = [], None
    for line in source.split("\n"):
        bare = line.lstrip()
        depth = len(line) - len(bare)
        if barrier is not None and (not bare or depth > barrier):
            continue
        barrier = None
        if bare != "pass":
            out.append(line)
            if regex.match(r"(return|raise|break|continue)\b", bare):
                barrier = depth
    return regex.sub(r"\n\s*\n+", "\n", "\n".join(out)).strip()


def random_text(rng: random.Random, sentences: int) -> str:
    """Sentences from few words, so that near copies, ties and repeats are common."""
    out = []
    for _ in range(sentences):
        if out and rng.random() < 0.3:
            ws = rng.choice(out)[:-1].split()
            if rng.random() < 0.7:
                ws[rng.randrange(len(ws))] = rng.choice(WORDS)
        else:
            ws = [rng.choice(WORDS) * rng.choice((1, 1, 2)) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.1:
            ws.append(str(rng.randint(1, 99)))
        out.append(" ".join(ws).capitalize() + rng.choice(".....!?"))
    return rng.choice((" ", "\n", "  ")).join(out)
