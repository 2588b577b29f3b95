"""Plain single-process versions that the operators are held against."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def simhash(text: str | None, shingle: int = 3) -> int:
    words = WORDS.findall(lower_az(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids: list, prints: list[int], radius: int = 3) -> list:
    """Least id reachable over links of at most radius differing bits, by trying all pairs."""
    f = np.array(prints, np.uint64)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            root[find(int(j))] = find(i)
    least: dict = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(f))]


def crc_ids(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def padding(rows, seq_len: int = 2048) -> tuple[int, int]:
    """(ids, padding) of packed rows (sequence_id, offset, length); checks that offsets are gapless."""
    by = Counter()
    ends: dict[int, list] = {}
    for s, o, n in rows:
        ends.setdefault(s, []).append((o, n))
    for s, parts in ends.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at, (s, o, at)
            at += n
        assert at <= seq_len
        by[s] = at
    pad = sum(0 if at & (at - 1) == 0 else seq_len - at for at in by.values())
    return sum(by.values()), pad


def shingles(words: list[str], k: int) -> Counter:
    return Counter(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))


def leaks(docs: list[tuple], items: list[tuple], similarity: float = 0.8) -> dict:
    """(doc, item): (similarity, start) of the first best item-sized window that is similar enough, by trying all."""
    out: dict = {}
    for d, text in docs:
        w = WORDS.findall((text or "").lower())
        for i, item in items:
            v = WORDS.findall((item or "").lower())
            k = min(5, len(v))
            if not v:
                continue
            want = shingles(v, k)
            for s in range(max(1, len(w) - len(v) + 1)):  # a text shorter than the item is one window
                have = shingles(w[s : s + len(v)], k)
                j = (have & want).total() / (have | want).total()
                if j >= similarity and ((d, i) not in out or j > out[d, i][0]):
                    out[d, i] = (j, s)
    return out


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORDS.findall(text)
    where: dict = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def pii(t: str) -> list[tuple]:
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        total = sum((int(c) * (1 + i % 2)) // 10 + (int(c) * (1 + i % 2)) % 10 for i, c in enumerate(reversed(d)))
        out += [("card", *m.span())] * (14 <= len(d) <= 19 and total % 10 == 0)
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def url_parts(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return lower_az(host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def url_rule(host: str, path: str, rules) -> tuple[str | None, str | None]:
    fit = [(len(h + p), h + p, said) for said, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def wide_prints(text: str | None, words: int = 8) -> list[int]:
    said = WORDS.findall(lower_az(text or ""))
    if not said:
        return [0] * words
    h = [xxhash.xxh64_intdigest(" ".join(said[i : i + 3]).encode(), 42) for i in range(max(1, len(said) - 2))]
    out = []
    for t in range(words):
        mixed = []
        for x in h:
            z = (x + t * 0x9E3779B97F4A7C15) % 2**64
            if t:
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
                z ^= z >> 31
            mixed.append(z)
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)))
    return out


def wide_components(ids: list, texts: list, limit: int = 64) -> list:
    f = [wide_prints(t) for t in texts]
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(f)):
        for j in range(i):
            apart = [(a ^ b).bit_count() for a, b in zip(f[i], f[j])]
            if apart[0] <= 3 or sum(apart) <= limit and any(((a ^ b) >> s & 0xFFFFFFFF).bit_count() <= 2 for a, b in zip(f[i][:5], f[j]) for s in (0, 32)):
                root[find(i)] = find(j)
    least: dict = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(f))]
