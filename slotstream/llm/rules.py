"""Quality rules by line labelling: a linear-chain conditional random field over the lines of a text.

Every line with a word is content or boilerplate; Viterbi decoding finds the likeliest labels and
the share of words on content lines decides whether the text stays.  A few base counts come
first: a text of under ``LEAST_WORDS`` words, or with over ``MOST_REPEATED`` percent of its words
in repeated 8-word windows, fails outright.

The field is learned from at most ``TRAIN_DOCS`` labelled texts (whole texts, those with the
smallest hash of their id): lines of good texts are content; lines of bad texts are boilerplate
unless the field, after a first round of learning, is sure of the contrary.

Defined cases: a null or empty text has no words and fails the base rules; lines without a word
have no label; without labels no line is boilerplate, so the base rules alone decide; an input
column named like a result column gives way to the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotstream.llm import base
from slotstream.llm.vector import SPACES, U64, Packed, Words, by_text, covered, mix, powers, window_hashes, window_starts

LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
LEAST_CONTENT = 0.5
TRAIN_DOCS = 2000
SYMBOLS = b"#*$%&|<>"
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
ADDED = COUNTS + ", content_share double, kept boolean"
#: Upper edges of the bins of each line feature.
BINS = [
    [2, 4, 8, 16, 32, 64],  # words
    [1e-9, 0.02, 0.08, 0.15],  # symbols a character
    [0.05, 0.2, 0.4, 0.7],  # capitals a letter
    [1e-9, 0.05, 0.2],  # digits a character
    [1e-9, 0.08, 0.2, 0.5],  # . , ; : ? a word
    [1e-9, 0.1, 0.5],  # ! a word
    [3, 5, 7, 10],  # characters a word
    [1e-9, 0.1, 0.4],  # words equal to the word before
    [1e-9, 0.3],  # words in repeated windows
    [0.5],  # equal to an earlier line
    [0.5],  # ends a sentence
    [0.1, 0.3, 0.6],  # distinct words a word
]
_SIZES = [len(b) + 1 for b in BINS]
_AT = np.concatenate(([0], np.cumsum(_SIZES)))[:-1]
FEATURES = int(sum(_SIZES))


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def _repeats(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of elements whose (group, key) came before, and of those that occur twice or more."""
    order = np.lexsort((np.arange(len(key)), key, group))
    g, k = group[order], key[order]
    same = np.zeros(len(key), bool)
    same[1:] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    both = same.copy()
    both[:-1] |= same[1:]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order], any_[order] = same, both
    return later, any_


class Lines:
    """Base counts of several texts, and the feature bins of each line with a word."""

    def __init__(self, texts: list[bytes | None]):
        packed = Packed(texts, b"\n")
        buf = packed.buf
        is_word = ~SPACES
        words = Words(packed, is_word)
        h = words.hashes(lower=False)
        flag = is_word[buf]
        chars = _sums(flag & ((buf & 0xC0) != 0x80))
        symbols = _sums(_table(SYMBOLS)[buf])
        self.n_words = words.count.astype(np.int64)
        self.word_chars = chars[packed.stop] - chars[packed.start]
        self.n_symbols = symbols[packed.stop] - symbols[packed.start]

        windows = window_hashes(h, WINDOW)
        place = np.flatnonzero(window_starts(words.first, WINDOW))
        doc_of_word = np.repeat(np.arange(packed.n), words.count)
        _, twice = _repeats(doc_of_word[place], windows[place])
        repeated = covered(words.first, place[twice], WINDOW)
        self.n_repeat_words = by_text(repeated.astype(np.int64), words.first)

        stop = np.flatnonzero(buf == 10)
        start = np.concatenate(([0], stop[:-1] + 1))
        doc = np.searchsorted(packed.stop, stop)
        first, last = np.searchsorted(words.start, start), np.searchsorted(words.start, stop)
        some = last > first
        start, stop, doc, first, last = start[some], stop[some], doc[some], first[some], last[some]
        sums = words.prefix_sums(lower=False)
        down = powers(len(buf))[1]
        line_hash = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U64))
        again, _ = _repeats(doc, line_hash)
        self.n_dup_lines = np.bincount(doc[again], minlength=packed.n)
        self.base_failed = (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)

        n = last - first
        self.doc, self.words = doc, n
        self.first = np.searchsorted(doc, np.arange(packed.n + 1))
        within = lambda sums: sums[stop] - sums[start]
        by_word = lambda flags: _sums(flags)[last] - _sums(flags)[first]
        size = np.maximum(1, within(chars))
        letters = np.maximum(1, within(_sums(_table(bytes([*range(65, 91), *range(97, 123)]))[buf])))
        line_of_word = np.repeat(np.arange(len(n)), n)
        at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(n) else first
        before = np.zeros(len(h), bool)
        before[1:] = h[1:] == h[:-1]
        seen, _ = _repeats(line_of_word, h[at])
        end = buf[words.stop[last - 1] - 1] if len(last) else buf[:0]
        values = [
            n,
            within(symbols) / size,
            within(_sums(_table(bytes(range(65, 91)))[buf])) / letters,
            within(_sums(_table(b"0123456789")[buf])) / size,
            within(_sums(_table(b".,;:?")[buf])) / np.maximum(1, n),
            within(_sums(buf == 33)) / np.maximum(1, n),
            within(chars) / np.maximum(1, n),
            by_word(before) / np.maximum(1, n),
            by_word(repeated) / np.maximum(1, n),
            again,
            _table(b".?!:")[end],
            1 - np.bincount(line_of_word[seen], minlength=len(n)) / np.maximum(1, n),
        ]
        self.bins = np.stack([a + np.searchsorted(b, np.asarray(v, float), "right") for a, b, v in zip(_AT, BINS, values, strict=True)], axis=1).astype(np.uint8)

    def counts(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}


def _padded(first: np.ndarray, values: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unequal length as one array (text, place, ...), and the mask of real places."""
    size = np.diff(first)
    out = np.full((len(size), max(1, int(size.max(initial=0))), *values.shape[1:]), fill, values.dtype)
    mask = np.arange(out.shape[1]) < size[:, None]
    out[mask] = values
    return out, mask


class Field:
    """A two-label linear-chain field: label 0 is boilerplate, label 1 content."""

    def __init__(self):
        self.emit = np.zeros((FEATURES, 2))
        self.emit[:, 1] = 1e-6
        self.step = np.zeros((2, 2))

    def energies(self, bins: np.ndarray) -> np.ndarray:
        return self.emit[bins].sum(axis=1)

    def viterbi(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest label of each line; all texts step together, the longest ones last."""
        energy = self.energies(bins)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        longest = int(size.max(initial=0))
        live = np.searchsorted(-size[order], -np.arange(longest), "left")  # texts with more than t lines
        best, came = np.zeros((len(size), 2)), np.zeros((len(bins), 2), np.int8)
        for t in range(longest):
            d = order[: live[t]]
            at = first[d] + t
            if t == 0:
                best[d] = energy[at]
            else:
                reach = best[d][:, :, None] + self.step
                came[at] = reach.argmax(axis=1)
                best[d] = reach.max(axis=1) + energy[at]
        labels, now = np.zeros(len(bins), np.int8), best.argmax(axis=1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            d = order[: live[t]]
            at = first[d] + t
            labels[at] = now[d]
            if t:
                now[d] = came[at, now[d]]
        return labels

    def marginals(self, energy: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of each label at each padded place, and expected counts of label pairs."""
        n, longest = mask.shape
        ahead, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = energy[:, 0]
        for t in range(1, longest):
            now = np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.step, axis=1) + energy[:, t]
            ahead[:, t] = np.where(mask[:, t, None], now, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            now = np.logaddexp.reduce(self.step + (energy[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(mask[:, t + 1, None], now, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(ahead + back - total[:, None, None]) * mask[..., None]
        pair = np.exp(ahead[:, :-1, :, None] + self.step + (energy[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        return chance, pair.sum(axis=(0, 1))

    def learn(self, bins: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 60) -> None:
        """Gradient steps (scaled by their history) on the likelihood of the labels."""
        seen = np.concatenate([bins[label == k].reshape(-1) + FEATURES * k for k in (0, 1)])
        have = np.bincount(seen, minlength=2 * FEATURES).reshape(2, FEATURES).T
        size = np.diff(first)
        groups = []  # texts of like length (the caller sorts them), so that little is padding
        lo = 0
        while lo < len(size):
            hi = int(np.searchsorted(size, 1.3 * size[lo] + 1, "right"))
            groups.append((*_padded(first[lo : hi + 1] - first[lo], np.arange(first[lo], first[hi]), 0), int(first[lo]), int(first[hi])))
            lo = hi
        inner = np.ones(len(bins), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (label[at - 1], label[at]), 1)
        emit_seen, step_seen = np.full_like(self.emit, 1e-6), np.full_like(self.step, 1e-6)
        for _ in range(rounds):
            energy, flat, pair = self.energies(bins), np.zeros((len(bins), 2)), np.zeros((2, 2))
            for grid, mask, start, stop in groups:
                chance, found = self.marginals(energy[grid], mask)
                flat[start:stop] = chance[mask]
                pair += found
            want = np.stack([np.bincount(bins.reshape(-1), np.repeat(flat[:, k], bins.shape[1]), FEATURES) for k in (0, 1)], axis=1)
            slope, slope_step = (have - want) / len(bins) - 1e-4 * self.emit, (pairs - pair) / len(bins) - 1e-4 * self.step
            emit_seen += slope**2
            step_seen += slope_step**2
            self.emit += 0.3 * slope / np.sqrt(emit_seen)
            self.step += 0.1 * slope_step / np.sqrt(step_seen)

    def verdict(self, texts: list[bytes | None]) -> dict[str, object]:
        lines = Lines(texts)
        content = self.viterbi(lines.bins, lines.first) == 1
        share = by_text(np.where(content, lines.words, 0), lines.first) / np.maximum(1, lines.n_words)
        return lines.counts() | {"content_share": share, "kept": ~lines.base_failed & (share >= LEAST_CONTENT)}


def trained(docs: list[tuple[np.ndarray, int]]) -> Field:
    """A field from (bins of a text's lines, label of the text)."""
    field = Field()
    docs = [(b, y) for b, y in docs if len(b)]
    if len({y for _, y in docs}) < 2:
        return field
    docs.sort(key=lambda x: len(x[0]))
    bins = np.concatenate([b for b, _ in docs])
    first = np.concatenate(([0], np.cumsum([len(b) for b, _ in docs])))
    text = np.repeat([y for _, y in docs], [len(b) for b, _ in docs])
    field.learn(bins, first, text)
    energy = field.energies(bins)
    sure = (energy[:, 1] - energy[:, 0]) > 1.0
    final = Field()
    final.learn(bins, first, np.where((text == 0) & sure, 1, text))
    return final


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Field:
    """Learn from the texts of ``labels`` (its rows with a 0/1 label)."""
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    sample = clean.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(most)
    rows = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(sample), id_col).select("__label", "__text")

    def bins(texts: list[bytes | None]) -> dict[str, object]:
        lines = Lines(texts)
        return {"bins": [lines.bins[a:b].tobytes() for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)]}

    got = base.with_columns(rows, "__text", "bins binary", bins).select("__label", "bins").collect()
    got.sort(key=lambda r: (bytes(r.bins), r[0]))
    return trained([(np.frombuffer(r.bins, np.uint8).reshape(-1, len(BINS)), r[0]) for r in got])


def judged(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed, content_share and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return base.with_columns(docs, text_col, ADDED, lambda texts: shared.value.verdict(texts))
