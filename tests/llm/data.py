"""Small tables with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

WIDE = "doc_id long, text string, lang string, source string, n_chars long, h string, k string, gone string"


def awkward_texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rnd = random.Random(seed)
    phrases = [" ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(2, 12))) for _ in range(9)]
    texts: list[str | None] = []
    for _ in range(n):
        texts.append("".join(rnd.choice(phrases) + rnd.choice([" ", "\n", ". ", "  \n", "\t"]) for _ in range(rnd.randint(0, 9))))
    texts += [None, "", " ", "\n", "a" * 400, "ab" * 150, "x", texts[3], texts[3], texts[3], "\x00 \x0b", "Ünï " * 40]
    texts.append(" ".join(rnd.choice(phrases) for _ in range(800)))
    return texts


def frame(spark, texts, repeat_ids: bool = False):
    """Documents with clashing extra columns that hold nulls."""
    rows = [(i, t, None if i % 3 else "en", None, len(t or ""), "h", None, "g") for i, t in enumerate(texts)]
    if repeat_ids:
        rows += [(2, "something else altogether", None, None, 1, None, None, None), (None, texts[0], None, None, 1, "h", "k", None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, WIDE).repartition(4)


def table(spark, folder, texts, repeat_ids: bool = False):
    """``frame``, written and read again, for operators that read their input more than once."""
    frame(spark, texts, repeat_ids).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def line_dedup(docs, min_docs=2, min_chars=10):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    owners: dict[str, set] = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            owners.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < min_chars or len(owners[key(x)]) < min_docs or i == min(owners[key(x)])]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def suffix_dedup(docs, length):
    first: dict[bytes, tuple] = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], (i, s))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] != (i, s):
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def exact_dedup(docs):
    groups: dict[str, list] = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for bare, members in groups.items():
        keep = min(members)[1]
        digest = hashlib.sha256(bare.encode()).hexdigest()
        for _, i in members:
            out[i] = (keep, len(members), i == keep, digest)
    return out


def base_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_words(text):
    return LICENSE_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def phrases_at(words, phrases):
    found = []
    for label, phrase in phrases.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return found


def importance_resampling(docs, target):
    """op12 by its contract: ``docs`` (doc_id, text) and target texts to rows by doc_id."""
    import math
    import zlib

    def feats(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        return words, [zlib.crc32(f.encode()) % 10000 for f in out]

    s, t = [0] * 10000, [0] * 10000
    for _, text in docs:
        for b in feats(text)[1]:
            s[b] += 1
    for text in target:
        for b in feats(text)[1]:
            t[b] += 1
    big_s, big_t = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, buckets = feats(text)
        weight = sum(gain[b] for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = int(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        rows.append([doc_id, len(buckets), weight, score, None, len(words)])
    eligible = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(eligible[: len(eligible) * 5 // 100], 1):
        r[4] = rank
    return rows


def hard_negatives(rows):
    """op13 by its contract over (vec_id, embedding, label) rows."""
    import math

    ok = []
    for vec_id, emb, label in rows:
        if vec_id is None or label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        if vec_id % 7 == 0:
            label = (label + 1) % 10
        ok.append((vec_id, label, [math.floor(256 * float(x)) for x in emb]))
    out, seen = [], set()
    for a_id, a_label, a in ok:
        if a_id % 100 or (a_id, a_label, tuple(a)) in seen:
            continue
        seen.add((a_id, a_label, tuple(a)))
        scored = [(sum(x * y for x, y in zip(a, v)), i, lab, v) for i, lab, v in ok]
        scored.sort(key=lambda t: (-t[0], t[1]))
        pos = [t for t in scored if t[2] == a_label and not (t[1] == a_id and t[3] == a)][:5]
        for ps, pid, _, _ in pos:
            neg = [t for t in scored if t[2] != a_label and 30 * ps <= 100 * t[0] <= 90 * ps][:10]
            out += [(a_id, pid, r, nid, ps, ns) for r, (ns, nid, _, _) in enumerate(neg, 1)]
    return out
