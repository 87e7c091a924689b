"""The contracts of the operators in plain Python, over lists of ``(doc_id, text)``."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(CASE))


def worded(text):
    return WORD.findall((text or "").translate(CASE))


def components(rows, size, least, of):
    """``{doc_id: (n_shingles, component)}`` for rows with different, non-null ids."""
    sets = {}
    for key, text in rows:
        words = spaced(text)
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}
        sets[key] = grams
    root = {key: key for key in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and of * both >= least * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {key: (len(sets[key]), find(key)) for key in keys}


def license_base(text, phrases):
    words, places, labels = worded(text), [], set()
    for phrase, label in phrases.items():
        wanted = phrase.split()
        for i in range(len(words) - len(wanted) + 1):
            if words[i : i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(labels))


def contamination(rows, items, window):
    found = defaultdict(set)
    for item, text in items:
        words = worded(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found[tuple(words[i : i + window])].add(str(item))
    sizes = {len(words) for words in found}
    out = []
    for key, text in rows:
        words, hit, names = worded(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in found:
                    hit.update(range(i, i + size))
                    names |= found[tuple(words[i : i + size])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(names), digest, bool(hit)))
    return out


def luhn(digits):
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else 2 * digit - 9 * (digit > 4)
    return total % 10 == 0


def private_spans(text):
    """Base spans ``(start, kind, end)``, kinds numbered in the order of the contract."""
    digits = lambda match: re.sub("[^0-9]", "", match.group())
    patterns = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(part) <= 255 for part in m.group().split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), nth, m.end()) for nth, (pattern, good) in enumerate(patterns, 1) for m in re.finditer(pattern, text or "") if good(m))


def without_repeats(rows, length):
    """``(n_bytes, n_removed, n_spans, sha256)`` of each row."""
    texts = [(text or "").encode() for _, text in rows]
    seen = Counter(text[i : i + length] for text in texts for i in range(len(text) - length + 1))
    out = []
    for text in texts:
        gone = set()
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone.update(range(i, i + length))
        kept = bytes(byte for i, byte in enumerate(text) if i not in gone)
        out.append((len(text), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return out


class Bigrams:
    """Interpolated modified Kneser-Ney with the discounts given."""

    def __init__(self, texts, pair_discounts, word_discounts):
        self.words, self.pairs = Counter(), Counter()
        for text in texts:
            tokens = [*spaced(text), None]
            self.words.update(tokens)
            self.pairs.update(zip(["<start>", *tokens[:-1]], tokens, strict=True))
        self.before = Counter(word for _, word in self.pairs)
        self.d2, self.d1 = pair_discounts, word_discounts
        self.total, self.left = Counter(), Counter()
        for (first, _), n in self.pairs.items():
            self.total[first] += n
            self.left[first] += self.d2[min(n, 3)]
        self.spread = sum(self.d1[min(n, 3)] for n in self.before.values()) / len(self.pairs)

    def probability(self, first, word):
        n = self.before[word]
        low = max(n - self.d1[min(n, 3)], 0) / len(self.pairs) + self.spread / (len(self.words) + 1)
        if not self.total[first]:
            return low
        n = self.pairs[first, word]
        return max(n - self.d2[min(n, 3)], 0) / self.total[first] + self.left[first] / self.total[first] * low

    def score(self, text):
        tokens = [*spaced(text), None]
        base = sum(math.log10((self.words[t] + 1) / (sum(self.words.values()) + len(self.words) + 1)) for t in tokens)
        full = sum(math.log10(self.probability(a, b)) for a, b in zip(["<start>", *tokens[:-1]], tokens, strict=True))
        return len(tokens), sum(self.words[t] > 0 for t in tokens), base, full


def fold(key, folds):
    return zlib.crc32(str(key).encode()) % folds
